"""Packing (operator 9): concatenate and cut.

All documents, in id order and each with its end id, form one long row of ids that is cut into windows
of `length`. Where a window begins follows from global offsets alone: the token files' ranges carry
their token totals, a prefix sum over these gives each range its offset, and every task cuts its own
documents without seeing others. Each cut leaves a boundary record (a piece). Only the last window is
padded.

A null text is empty (one piece: the end id). Repeated rows are packed each. No rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.token_files import TokenFiles, id_views, lists

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pieces(files: TokenFiles, length: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place in the document, sequence and offset there; `with_ids`
    adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, blobs = [], []
            keys, starts = batch.column("doc_id").to_pylist(), batch.column("start").to_pylist()
            for key, start, ids in zip(keys, starts, id_views(batch.column("ids")), strict=True):
                n, done = len(ids), 0
                while done < n:
                    sequence, offset = divmod(start + done, length)
                    take = min(n - done, length - offset)
                    blob = np.ascontiguousarray(ids[done : done + take], dtype="<i4").tobytes()
                    out.append((key, done, take, zlib.crc32(blob), n, sequence, offset))
                    if with_ids:
                        blobs.append(blob)
                    done += take
            columns = [pa.array(c, type=pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(NAMES))]
            if with_ids:
                yield pa.RecordBatch.from_arrays([*columns, lists(blobs)], names=[*NAMES, "ids"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return files.documents().mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def sequences(cut: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """The packed sequences of `pieces(..., with_ids=True)`: `ids` padded to `length`, `n_tokens`, and
    `doc_ids` with `lengths` of the pieces in order. A group has at most `length` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    ids = F.flatten(F.col("parts.ids"))
    return cut.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(ids))).alias("ids"),
        F.size(ids).alias("n_tokens"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    )
