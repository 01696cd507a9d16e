"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.pieces import release
from riskweave.sources.shared import fresh_dir

#: A key is hot when it holds more than this share of the rows, so at most 1,000 keys are hot.
HOT_SHARE = 1 / 1000

#: ASCII white space: what parts words from each other in every operator here.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df` written once under the shared folder and read back: work is not repeated after it, and a
    lost executor does not take it along. Zstandard keeps texts in two thirds of the room of the default."""
    spark = df.sparkSession
    folder = fresh_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one where `df` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_workers(spark: SparkSession) -> None:
    """Let the Python workers give up the models and caches of earlier stages. Small tasks, several per
    core, reach the idle workers one after the other; a worker that none reaches keeps one model, as it would."""
    tasks = 4 * spark.sparkContext.defaultParallelism

    def give_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from batches

    spark.range(0, tasks, 1, tasks).mapInArrow(give_up, "id long").write.format("noop").mode("overwrite").save()


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key's decimal text, modulo `divisor`. A missing key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def join_by_group(
    rows: DataFrame, groups: DataFrame, key: str, group_rows: str, total: int, how: str = "inner"
) -> DataFrame:
    """Join stored `rows` to stored `groups` (one row per key; `group_rows` counts its rows).

    The at most 1,000 keys over `HOT_SHARE` of all `total` rows are broadcast, so their rows stay
    where they are; the rows of all other keys are shuffled. Keys are never null. `how` may be
    "left" for rows without a group.
    """
    limit = int(total * HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(group_rows) > limit))
    cold = groups.where(F.col(group_rows) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))
