"""Handling of keys that hold a large part of all rows.

Layout decisions are taken from exact, map-side-combined counts; they never change a result, only
how many tasks share a key.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import timecols

# A key with more rows than this is shared by several tasks.
ROWS_PER_TASK = 2_000_000
# The hot-key list is collected, so it is bounded: a key outside the heaviest MAX_HOT_KEYS holds at
# most 1/MAX_HOT_KEYS of the rows and needs no splitting.
MAX_HOT_KEYS = 10_000
# Parts that the rows of one hot key are cut into at most.
MAX_CUTS = 1_000
# A dimension of at most this many rows is broadcast.
MAX_BROADCAST_ROWS = 100_000
_SALT = "__salt"


@dataclass(frozen=True)
class HotKeys:
    """Heavy keys with the number of tasks (`__parts`) and the instants that cut their rows into parts of
    like size (`__cuts`) of each."""

    keys: tuple[str, ...]
    rows: DataFrame

    def mark(self, df: DataFrame) -> DataFrame:
        """Add `__parts` and `__cuts`; NULL for ordinary keys. The list has a fixed bound."""
        return df.join(F.broadcast(self.rows), list(self.keys), "left")


def find_hot_keys(
    df: DataFrame,
    keys: list[str],
    at: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> HotKeys | None:
    """Keys with more than `rows_per_task` rows, or None. `at` is the time column of later scans."""
    # A plain count needs no shuffle and settles the matter for tables that fit one task.
    if df.count() <= rows_per_task:
        return None
    heavy = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > rows_per_task)
        .orderBy(F.col("__n").desc(), *keys)
        .limit(MAX_HOT_KEYS)
    )
    found = heavy.collect()
    if not found:
        return None
    schema = heavy.select(*keys).schema.add("__parts", "long")
    rows = [(*[r[k] for k in keys], math.ceil(r["__n"] / rows_per_task)) for r in found]
    listed = df.sparkSession.createDataFrame(rows, schema)
    if at is None:
        return HotKeys(tuple(keys), listed.withColumn("__cuts", F.lit(None).cast("array<bigint>")))
    # Quantiles, not equal widths: a flood within a second is cut as finely as a quiet year.
    shares = min(MAX_CUTS, 2 * max(r[-1] for r in rows))
    points = [i / shares for i in range(1, shares)]
    cuts = (
        df.withColumn("__at", timecols.micros(at))
        .join(F.broadcast(listed.select(*keys)), keys)
        .groupBy(*keys)
        .agg(F.percentile_approx("__at", points, 20 * shares).alias("__cuts"))
    )
    kept = [(*[r[k] for k in keys], r["__cuts"]) for r in cuts.collect()]  # one row per hot key
    table = df.sparkSession.createDataFrame(kept, heavy.select(*keys).schema.add("__cuts", T.ArrayType(T.LongType())))
    return HotKeys(tuple(keys), listed.join(F.broadcast(table), keys, "left"))


def join_to_unique(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    hot: HotKeys | None,
    spread_by: list[str],
) -> DataFrame:
    """Join to a side with one row per key. Hot keys of `left` are split by a hash of `spread_by`,
    and the single matching `right` row is copied to each part."""
    if hot is None:
        return left.join(right, keys, how)
    share = F.pmod(F.xxhash64(*spread_by), F.col("__parts"))
    salted = hot.mark(left).withColumn(_SALT, F.coalesce(share, F.lit(0).cast("bigint")))
    copies = (
        hot.mark(right)
        .withColumn(
            _SALT,
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__parts") - 1, F.lit(0)))),
        )
        .drop("__parts", "__cuts")
    )
    return salted.drop("__parts", "__cuts").join(copies, [*keys, _SALT], how).drop(_SALT)


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def touching(
    stored: DataFrame, new: DataFrame, keys: list[str], max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Rows of a large stored table whose key occurs in `new`. Few new keys are broadcast, so the
    stored table is read but not shuffled."""
    wanted = new.select(*keys).distinct()
    if is_small(wanted, max_rows):
        wanted = F.broadcast(wanted)
    return stored.join(wanted, keys, "left_semi")


def join_dimension(
    left: DataFrame,
    dim: DataFrame,
    condition: list[Column],
    equal_on: tuple[str, str],
    how: str,
    spread_by: list[str],
    max_rows: int = MAX_BROADCAST_ROWS,
    parts: int = 64,
) -> DataFrame:
    """Join facts to a dimension on `equal_on` plus `condition`.

    The dimension is broadcast when it was counted to be small. A larger one is shuffled, with
    every fact key spread over `parts` salts so that one heavy key cannot fill a task.
    """
    fact_key, dim_key = equal_on
    if is_small(dim, max_rows):
        return left.join(
            F.broadcast(dim), [F.col(fact_key) == F.col(dim_key), *condition], how
        )
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")
    copies = dim.withColumn("__dim_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (
        left.withColumn(_SALT, salt)
        .join(
            copies,
            [F.col(fact_key) == F.col(dim_key), F.col(_SALT) == F.col("__dim_salt"), *condition],
            how,
        )
        .drop(_SALT, "__dim_salt")
    )
