"""Exact deduplication (operator 2) with two Bloom passes.

Pass one reads only hashes. Every task sets the bits of its rows' hashes in a blocked Bloom filter
("once") and those that it meets again in a second one ("twice"). Tasks send the touched blocks, a few
bytes per row; blocks are merged by `twice = twice | twice' | (once & once')`. A hash of two rows has
all its bits in the merged "twice" filter, whichever tasks held them.

Pass two tests each row against it. Rows that miss are unique: they go straight through, unshuffled.
The others (true repeats and a few false alarms) are stored, grouped by the full key and marked.

The filter has `BITS_PER_ROW` bits for each row, and at most `MAX_FILTER_BYTES`. A larger table is
written once, dealt by hash into as many folders as filters are needed, and each folder is handled
with a filter of its own; results are equal at every size.

Nulls: a null key column is not allowed (callers define what a null text means); a null order value is
the smallest. Of rows that tie in key and order value, exactly one stays. Added columns replace input
columns of the same name; columns used inside take names that the input doesn't have. Texts of any length
are hashed whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import fresh_name, join_by_group, stored

BITS_PER_ROW = 16
MAX_FILTER_BYTES = 64 << 20
PROBES = 3
#: Bits of a block: all probes of a hash fall into one block of 4 kB.
BLOCK_BITS = 1 << 15
MIN_BLOCKS = 256


def slots(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Bit numbers of each hash, one row per probe; `blocks` is a power of two."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(45)) & np.uint64(blocks - 1)
    probes = [(h >> np.uint64(15 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PROBES)]
    return (block << np.uint64(15) | np.array(probes)).astype(np.int64)


def packed(bits: np.ndarray) -> bytes:
    """Sorted bit numbers of a block: as they are when few, else as a bitmap."""
    if len(bits) * 2 < BLOCK_BITS // 8:
        return bits.astype("<u2").tobytes()
    return bitmap(bits).tobytes()


def bitmap(bits: np.ndarray) -> np.ndarray:
    flags = np.zeros(BLOCK_BITS, dtype=np.uint8)
    flags[bits] = 1
    return np.packbits(flags, bitorder="little")


def unpacked(blob: bytes) -> np.ndarray:
    if len(blob) == BLOCK_BITS // 8:
        return np.frombuffer(blob, dtype=np.uint8)
    return bitmap(np.frombuffer(blob, dtype="<u2"))


def touched_blocks(blocks: int):
    """Hashes of a partition -> (block, once, twice) for each block with a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not hashes:
            return
        distinct, counts = np.unique(np.concatenate(hashes), return_counts=True)
        once = np.unique(slots(distinct, blocks))
        twice = np.unique(slots(distinct[counts > 1], blocks))
        found = np.unique(once // BLOCK_BITS)

        def parts(bits):
            edges = np.searchsorted(bits, np.append(found, found[-1] + 1 if len(found) else 0) * BLOCK_BITS)
            ends = np.append(edges[1:-1], len(bits)) if len(found) else edges[1:]
            return [packed(bits[a:b] % BLOCK_BITS) for a, b in zip(edges[: len(found)], ends, strict=True)]

        columns = [pa.array(found, type=pa.int64()), pa.array(parts(once)), pa.array(parts(twice))]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "once", "twice"])

    return run


def merged_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of each block -> its merged "twice" bits, where there are any."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            new, again = unpacked(a), unpacked(b)
            if block in once:
                twice[block] = twice[block] | again | (once[block] & new)
                once[block] = once[block] | new
            else:
                once[block], twice[block] = new, again
    kept = {k: v.tobytes() for k, v in twice.items() if v.any()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(kept), type=pa.int64()), pa.array(list(kept.values()), type=pa.binary())], names=["block", "twice"]
    )


def repeated_filter(hashes: DataFrame, blocks: int) -> bytearray:
    """The "twice" filter of a one-column frame of hashes: at most `MAX_FILTER_BYTES` on the driver."""
    touched = hashes.mapInArrow(touched_blocks(blocks), "block long, once binary, twice binary")
    merged = touched.repartition("block").mapInArrow(merged_blocks, "block long, twice binary")
    bits = bytearray(blocks * BLOCK_BITS // 8)
    for block, twice in merged.toLocalIterator():
        bits[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = twice
    return bits


def blocks_for(rows: int) -> int:
    need = max(MIN_BLOCKS, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    return 1 << (need - 1).bit_length()


def exact_dedup(df: DataFrame, key: str, order: str, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds `keep_id` (largest `order` among rows of an equal `key`), `group_size` and `kept` (true for
    one row of each group: the one with the largest `order`)."""
    df = df.drop("keep_id", "group_size", "kept")
    total = df.count()
    filters = -(-blocks_for(total) * BLOCK_BITS // 8 // max_filter_bytes)
    if filters == 1:
        return dedup_with_filter(df, key, order, blocks_for(total), total)
    deal = fresh_name(df, "deal")
    dealt = stored(df.withColumn(deal, F.pmod(F.xxhash64(F.lit("deal"), key), F.lit(filters))), "deal", deal)
    out = None
    for i in range(filters):
        own = dealt.where(F.col(deal) == i).drop(deal)
        part = dedup_with_filter(own, key, order, blocks_for(-(-total // filters)), total)
        out = part if out is None else out.unionByName(part)
    return out


def dedup_with_filter(df: DataFrame, key: str, order: str, blocks: int, total: int) -> DataFrame:
    spark = df.sparkSession
    h = F.xxhash64(key)
    maybe, row, head = (fresh_name(df, name) for name in ("maybe", "row", "head"))
    bits = spark.sparkContext.broadcast(bytes(repeated_filter(df.select(h.alias("h")), blocks)))

    @F.pandas_udf("boolean")
    def maybe_repeated(hashes: pd.Series) -> pd.Series:
        at = slots(hashes.to_numpy(), blocks)
        table = np.frombuffer(bits.value, dtype=np.uint8)
        return pd.Series(((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0))

    tested = df.withColumn(maybe, maybe_repeated(h))
    unique = tested.where(~F.col(maybe)).drop(maybe).select(
        "*", F.col(order).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    again = tested.where(F.col(maybe)).drop(maybe).withColumn(row, F.monotonically_increasing_id())
    again = stored(again, "repeats")
    last = F.max(F.struct(F.col(order).alias("id"), F.col(row).alias("row"))).alias(head)
    groups = stored(again.groupBy(key).agg(last, F.count(F.lit(1)).alias("group_size")), "groups")
    joined = join_by_group(again, groups, key, "group_size", total)
    marked = joined.select(
        *df.columns,
        F.col(f"{head}.id").alias("keep_id"),
        "group_size",
        (F.col(row) == F.col(f"{head}.row")).alias("kept"),
    )
    return unique.unionByName(marked)


def text_key(text: str = "text"):
    """sha256 of a text in UTF-8; a null text is the empty text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
