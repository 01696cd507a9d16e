"""Ordered running aggregates that do not put a hot key into one task."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import timecols
from riskweave.operators.skew import HotKeys

_CHUNK = "__chunk"
_COLD = -1


@dataclass(frozen=True)
class Running:
    """A running MAX or MIN of `value`; `inclusive` says whether the current row takes part.

    Both can be merged piecewise, which is what allows a key to be cut into time chunks.
    """

    name: str
    value: Column
    kind: str = "max"
    inclusive: bool = True

    def aggregate(self, column: Column) -> Column:
        return F.max(column) if self.kind == "max" else F.min(column)

    def merge(self, left: Column, right: Column) -> Column:
        return F.greatest(left, right) if self.kind == "max" else F.least(left, right)


def running(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: list[str],
    values: list[Running],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add each running aggregate over `keys`, ordered by `at` then `tie`.

    Ordinary keys take one window. A hot key is cut at quantiles of its time: every chunk is
    aggregated map-side, the chunk results are scanned, and each chunk's window starts from the
    result of the chunks before it. Rows of one key and one instant stay together.
    """
    for v in values:
        df = df.withColumn(v.name, v.value)
    if hot is None:
        return _windowed(df, keys, at, tie, values)

    now = timecols.micros(F.col(at))
    chunk = F.size(F.filter("__cuts", lambda c: c < now)).cast("bigint")
    cut = (
        hot.mark(df)
        .withColumn(_CHUNK, F.when(F.col("__cuts").isNull(), _COLD).otherwise(chunk).cast("bigint"))
        .drop("__parts", "__cuts")
    )
    # Chunks per key are bounded by twice the number of its tasks, so this scan is small.
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.filter(F.col(_CHUNK) != _COLD)
        .groupBy(*keys, _CHUNK)
        .agg(*[v.aggregate(F.col(v.name)).alias(v.name) for v in values])
        .select(
            *keys,
            _CHUNK,
            *[v.aggregate(F.col(v.name)).over(earlier).alias(f"__carry_{v.name}") for v in values],
        )
    )
    joined = cut.join(
        carried.select(
            *[F.col(k).alias(f"__c_{k}") for k in keys],
            F.col(_CHUNK).alias("__c_chunk"),
            *[f"__carry_{v.name}" for v in values],
        ),
        [F.col(k).eqNullSafe(F.col(f"__c_{k}")) for k in keys]
        + [F.col(_CHUNK) == F.col("__c_chunk")],
        "left",
    ).drop("__c_chunk", *[f"__c_{k}" for k in keys])
    local = _windowed(joined, [*keys, _CHUNK], at, tie, values)
    for v in values:
        local = local.withColumn(v.name, v.merge(F.col(v.name), F.col(f"__carry_{v.name}")))
    return local.drop(_CHUNK, *[f"__carry_{v.name}" for v in values])


def _windowed(
    df: DataFrame, keys: list[str], at: str, tie: list[str], values: list[Running]
) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(at, *tie)
    results = {}
    for v in values:
        frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1)
        results[v.name] = v.aggregate(F.col(v.name)).over(frame)
    return df.withColumns(results)
