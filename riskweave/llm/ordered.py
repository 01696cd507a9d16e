"""Exclusive prefix sums over a table in a global order, in two passes.

The rows are dealt into ranges of the order and sorted inside them. Each range keeps running sums of
its own; the sums of the ranges (one row each) are accumulated and added in the second pass. No task
sees more than one range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import stored

PART = "range_part"


def local_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """First pass: adds `PART` and, for each value column v, `v_before` within the range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    added = [T.StructField(f"{v}_before", T.LongType()) for v in values]
    schema = T.StructType([*ranged.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(values, 0)
        for batch in batches:
            columns = list(batch.columns)
            for v in values:
                each = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                through = np.cumsum(each) + so_far[v]
                columns.append(pa.array(through - each))
                so_far[v] = int(through[-1]) if len(through) else so_far[v]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"{v}_before" for v in values)])

    return ranged.mapInArrow(run, schema)


def part_bases(parts: DataFrame, totals: Sequence[str], part: str = PART) -> DataFrame:
    """One row per range: the sums of all ranges before it, as `t_base`. `parts` has one row a range."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        part, *(F.coalesce(F.sum(t).over(before), F.lit(0)).cast("long").alias(f"{t}_base") for t in totals)
    )


def prefix_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], name: str) -> DataFrame:
    """Both passes; `v_before` is then the sum of v over all earlier rows. The table is stored between."""
    first = stored(local_sums(df, order, values), name)
    parts = first.groupBy(PART).agg(*(F.sum(v).alias(v) for v in values))
    # One row per range: bounded by the number of partitions, however large the table.
    bases = F.broadcast(part_bases(parts, values))
    summed = first.join(bases, PART)
    for v in values:
        summed = summed.withColumn(f"{v}_before", F.col(f"{v}_before") + F.col(f"{v}_base"))
    return summed.drop(PART, *(f"{v}_base" for v in values))
