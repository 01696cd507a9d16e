"""Token-id files (operator 1): ORC with run-length encoded ids, row indexes and Bloom filters.

Layout of a folder:

* `data/`: ORC files in ascending id order, across the files and inside each. Columns: the document
  id, `part` (number of the file's range), `part_start` (ids in the range before the document),
  `n_tokens`, and `ids` (ORC run-length encodes integers). Each stripe has row indexes and a Bloom
  filter on the document id, so a search for documents skips stripes and row groups by metadata, and
  stripes of one file are read in parallel.
* `manifest/`: one ORC row per range: rows, tokens, smallest and largest id, and `start`, the ids in
  all ranges before it. A document's global start is `start + part_start`.

A null text is empty. Null ids come first; rows of one id are ordered by a hash of the text. Every row
is kept, repeated ones too. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.ordered import part_bases
from riskweave.llm.pieces import PieceEncoder, of_worker

#: Bytes of text that a task encodes before it hands their ids on: enough that pieces repeat, so that most are
#: told apart in bulk.
PORTION = 1 << 22
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def lists(blobs: list[bytes]) -> pa.ListArray:
    """Arrow lists of 32-bit integers over the ids of each blob."""
    offsets = np.zeros(len(blobs) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"), type=pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


def id_views(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row, without a copy."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def text_portions(column: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch, about `PORTION` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    portion = (np.cumsum(sizes) - sizes) // PORTION
    bounds = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(column)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            yield column.slice(a, b - a)


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids with the end id after each text."""
    if end_id is None:
        return counts, ids
    return counts + 1, np.insert(ids, np.cumsum(counts), end_id)


def encoder(path: str, end_id: int | None):
    """Rows (doc_id, part, text) in range order -> the rows of a data file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = of_worker(("pieces", path), lambda: PieceEncoder(path)).encode_column
        so_far = 0
        for batch in batches:
            at = 0
            for texts in text_portions(batch.column("text")):
                counts, ids = with_end(*encode(texts), end_id)
                key, part = (batch.column(c).slice(at, len(texts)) for c in ("doc_id", "part"))
                through = np.cumsum(counts)
                offsets = np.concatenate([[0], through]).astype(np.int32)
                lists_of_ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [key, part, pa.array(so_far + through - counts), pa.array(counts), lists_of_ids],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                at += len(texts)
                so_far += int(through[-1])

    return run


@dataclass(frozen=True)
class TokenFiles:
    """Token files in a folder that all executors reach."""

    spark: SparkSession
    folder: str

    def data(self) -> DataFrame:
        return self.spark.read.schema(
            "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
        ).orc(f"{self.folder}/data")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(
            "part int, rows long, tokens long, min_id long, max_id long, start long"
        ).orc(f"{self.folder}/manifest")

    def documents(self) -> DataFrame:
        """Each document with the ids of all documents before it as `start`. The manifest has one row
        per range, so it is small enough to broadcast at any size of the data."""
        starts = self.manifest().select("part", F.col("start").alias("base"))
        return (
            self.data()
            .join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")
        )

    def find(self, ids: list[int]) -> DataFrame:
        """Some documents by id: the filter reaches the stripes' statistics and Bloom filters."""
        return self.data().where(F.col("doc_id").isin([int(i) for i in ids])).select("doc_id", "n_tokens", "ids")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> TokenFiles:
    """Encode every whole text and write the folder. Texts are shuffled once, into ranges of ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ranged.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(
        encoder(tokenizer, end_id), "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
    )
    encoded.write.options(**ORC_OPTIONS).orc(f"{folder}/data")
    files = TokenFiles(spark, folder)
    parts = files.data().groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("n_tokens").alias("tokens"),
        F.min("doc_id").alias("min_id"),
        F.max("doc_id").alias("max_id"),
    )
    bases = part_bases(parts, ["tokens"], "part").withColumnRenamed("tokens_base", "start")
    parts.join(bases, "part").coalesce(1).write.orc(f"{folder}/manifest")
    return files


def with_crc32(documents: DataFrame) -> DataFrame:
    """`ids` replaced by `ids_crc32`: unsigned crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.ascontiguousarray(v, dtype="<i4")) for v in id_views(batch.column("ids"))]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return documents.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
