"""Policy versions as a table: which one is in force for each request, however many there are.

There is no key to join by, only time. Requests and versions are dealt into hours; each hour gets the last version of
the hours before it as one row more; the version in force is then a running MAX over the hour, in one
shuffle. An hour with very many rows is cut at quantiles of its time, as any hot key (`scans`). Nothing is collected.
"""

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions import timecols
from riskweave.functions.policy import SETTING_TYPES, PolicyConfig, PolicyVersions
from riskweave.operators import scans
from riskweave.operators.skew import ROWS_PER_TASK, find_hot_keys, is_small

#: Up to so many versions stand in an expression.
MAX_LITERAL = 64
_HOUR = 3_600_000_000


def _faults() -> dict[str, Column]:
    """The rules of `PolicyConfig`, as columns that are TRUE for a row that breaks one."""
    scores = [F.col(c).between(0, 100) for c in ("step_up_at", "block_at")]
    return {
        "valid_from is missing": F.col("valid_from").isNull(),
        "step_up_at and block_at must be within 0..100": ~(scores[0] & scores[1]),
        "step_up_at must not exceed block_at": F.col("step_up_at") > F.col("block_at"),
        "step_up_above_amount_minor must not be negative": F.col("step_up_above_amount_minor") < 0,
        "min_confidence_to_block must be within 0..1": ~F.col("min_confidence_to_block").between(0, 1),
        "min_banks_to_block must be at least 1": F.col("min_banks_to_block") < 1,
        "on_bus_unavailable must be step_up or block": ~F.col("on_bus_unavailable").isin(K.STEP_UP, K.BLOCK),
    }


@dataclass(frozen=True)
class PolicyTable:
    """Versions by `valid_from`, one at an instant; the first one also governs everything before."""

    frame: DataFrame

    @classmethod
    def of(cls, table: DataFrame) -> "PolicyTable":
        """From `valid_from` and any of the settings; the others, and NULL ones, have their defaults."""
        defaults = {f.name: f.default for f in fields(PolicyConfig)}
        unknown = set(table.columns) - set(defaults) - {"valid_from"}
        if unknown:
            raise ValueError(f"unknown policy settings: {sorted(unknown)}")
        given = {
            name: F.coalesce(F.col(name) if name in table.columns else F.lit(None), F.lit(value)).cast(SETTING_TYPES[name])
            for name, value in defaults.items()
        }
        full = table.select("valid_from", *(c.alias(name) for name, c in given.items()))
        faults = {why: F.count_if(F.coalesce(bad, F.lit(True))) for why, bad in _faults().items()}
        total, distinct, *found = full.agg(F.count(F.lit(1)), F.count_distinct("valid_from"), *faults.values()).first()
        broken = [why for why, n in zip(faults, found, strict=True) if n]
        if broken or not total:
            raise ValueError("; ".join(broken) or "at least one policy version is needed")
        if distinct < total:
            raise ValueError("two policy versions take effect at the same instant")
        return cls(full.select("valid_from", F.struct(*defaults).alias("policy")))

    def apply(self, rows: DataFrame, at: str = "request_ts", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """`rows` with `policy`, the version in force at `at`; rows without a time have the first."""
        version = F.struct("valid_from", "policy")
        slot = F.floor(timecols.micros(F.col("__at")) / F.lit(_HOUR))
        asked = rows.withColumns({"__at": F.col(at), "__kind": F.lit(1)}).withColumn("__slot", slot)
        starts = self.frame.select(
            F.col("valid_from").alias("__at"), F.lit(0).alias("__kind"), version.alias("__version")
        ).withColumn("__slot", slot)
        # One row per hour, however many requests or versions: the last version of the hours before.
        last = starts.select("__slot", "__version").unionByName(
            asked.select("__slot", F.lit(None).cast(starts.schema["__version"].dataType).alias("__version"))
        )
        hours = last.filter("__slot IS NOT NULL").groupBy("__slot").agg(F.max("__version").alias("__last"))
        before = F.max("__last").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
        carried = hours.select("__slot", before.alias("__version"), F.lit(0).alias("__kind")).filter("__version IS NOT NULL")
        carried = carried.withColumn("__at", F.col("__version.valid_from"))
        merged = asked.unionByName(starts, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
        hot = find_hot_keys(merged, ["__slot"], F.col("__at"), rows_per_task)
        seen = scans.running(merged, ["__slot"], "__at", ["__kind"], [scans.Running("__version", F.col("__version"))], hot)
        first = self.frame.agg(F.min_by("policy", "valid_from")).scalar()
        policy = F.coalesce(F.col("__version.policy"), first)
        return seen.filter("__kind = 1").withColumn("policy", policy).select(*(c for c in rows.columns if c != "policy"), "policy")


def policies_of(table: DataFrame) -> PolicyVersions | PolicyTable:
    """Few versions as an expression, more as a table; decisions are equal."""
    return PolicyVersions.from_table(table) if is_small(table, MAX_LITERAL) else PolicyTable.of(table)
