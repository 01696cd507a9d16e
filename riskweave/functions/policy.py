"""Threshold policy: configuration, versions and the decision expression."""

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K

#: Versions that may stand in an expression; `operators.policies` takes any number as a table.
MAX_POLICY_VERSIONS = 10_000
SETTING_TYPES = {
    "step_up_at": "int",
    "block_at": "int",
    "step_up_above_amount_minor": "bigint",
    "min_confidence_to_block": "double",
    "min_banks_to_block": "int",
    "on_bus_unavailable": "string",
}


@dataclass(frozen=True)
class PolicyConfig:
    """Score thresholds (both inclusive) and the limits on blocking."""

    step_up_at: int = 50
    block_at: int = 85
    step_up_above_amount_minor: int = 10_000_000
    min_confidence_to_block: float = 0.5
    min_banks_to_block: int = 1
    on_bus_unavailable: str = K.STEP_UP

    def __post_init__(self) -> None:
        for name in ("step_up_at", "block_at"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be within 0..100")
        if self.step_up_at > self.block_at:
            raise ValueError("step_up_at must not exceed block_at")
        if self.step_up_above_amount_minor < 0:
            raise ValueError("step_up_above_amount_minor must not be negative")
        if not 0.0 <= self.min_confidence_to_block <= 1.0:
            raise ValueError("min_confidence_to_block must be within 0..1")
        if self.min_banks_to_block < 1:
            raise ValueError("min_banks_to_block must be at least 1")
        if self.on_bus_unavailable not in (K.STEP_UP, K.BLOCK):
            raise ValueError("on_bus_unavailable must be step_up or block, never allow")

    def as_struct(self) -> Column:
        return F.struct(*[F.lit(getattr(self, name)).cast(kind).alias(name) for name, kind in SETTING_TYPES.items()])


@dataclass(frozen=True)
class PolicyVersions:
    """Policies by the instant they take effect; the first one also governs everything before."""

    versions: tuple[tuple[datetime, PolicyConfig], ...]

    def __post_init__(self) -> None:
        if not self.versions:
            raise ValueError("at least one policy version is needed")
        starts = [start for start, _ in self.versions]
        if starts != sorted(set(starts)):
            raise ValueError("policy versions must be in strictly ascending order")

    @classmethod
    def single(cls, policy: PolicyConfig | None = None) -> "PolicyVersions":
        return cls(((datetime(1970, 1, 1), policy or PolicyConfig()),))

    @classmethod
    def from_table(cls, table: DataFrame) -> "PolicyVersions":
        """Read a version table (`valid_from` + one column per setting); extra columns are refused."""
        names = {f.name for f in fields(PolicyConfig)}
        unknown = set(table.columns) - names - {"valid_from"}
        if unknown:
            raise ValueError(f"unknown policy settings: {sorted(unknown)}")
        rows = table.limit(MAX_POLICY_VERSIONS + 1).collect()
        if len(rows) > MAX_POLICY_VERSIONS:
            raise ValueError(f"more than {MAX_POLICY_VERSIONS} policy versions")
        settings = [r.asDict() for r in rows]
        return cls(tuple(sorted(
            ((s.pop("valid_from"), PolicyConfig(**s)) for s in settings), key=lambda v: v[0]
        )))

    def at(self, request_ts: Column) -> Column:
        """The policy struct in force at `request_ts`."""
        chosen = self.versions[0][1].as_struct()
        if len(self.versions) == 1:
            return chosen
        table = F.array(*[
            F.struct(F.lit(start).cast("timestamp_ntz").alias("valid_from"),
                     policy.as_struct().alias("policy"))
            for start, policy in self.versions
        ])
        in_force = F.array_max(F.filter(table, lambda v: v["valid_from"] <= request_ts))
        return F.coalesce(in_force["policy"], chosen)


def decision(
    status: Column,
    score: Column,
    amount_minor: Column,
    confidence: Column,
    banks: Column,
    policy: Column,
    strict: bool = False,
) -> Column:
    """The decision as one expression. An unknown status, or a found account without a score, takes the
    decision that the policy has for outages; with `strict` it is an error instead."""
    outage = policy["on_bus_unavailable"]
    if strict:
        malformed = F.raise_error(
            F.concat(F.lit("malformed evidence, status "), F.coalesce(status, F.lit("NULL")))
        ).cast("string")
    else:
        malformed = outage
    by_amount = F.when(
        amount_minor > policy["step_up_above_amount_minor"], F.lit(K.STEP_UP)
    ).otherwise(F.lit(K.ALLOW))
    unsure = confidence.isNotNull() & (confidence < policy["min_confidence_to_block"])
    alone = banks < policy["min_banks_to_block"]
    found = (
        F.when(score.isNull(), malformed)
        .when((score >= policy["block_at"]) & (unsure | alone), F.lit(K.STEP_UP))
        .when(score >= policy["block_at"], F.lit(K.BLOCK))
        .when(score >= policy["step_up_at"], F.lit(K.STEP_UP))
        .otherwise(by_amount)
    )
    return (
        F.when(status == K.UNAVAILABLE, outage)
        .when(amount_minor.isNull(), malformed)
        .when(status == K.NOT_FOUND, by_amount)
        .when(status == K.FOUND, found)
        .otherwise(malformed)
    )


# Customer copy. It names neither a score nor a bank: that would let a fraudster probe accounts.
CUSTOMER_COPY = {
    K.ALLOW: "Your transfer has been accepted.",
    K.STEP_UP: "Please confirm that it is you before we send this transfer.",
    K.BLOCK: "We have stopped this transfer to protect you. Contact us if you think we are wrong.",
}


def customer_message(decided: Column) -> Column:
    return (
        F.when(decided == K.BLOCK, F.lit(CUSTOMER_COPY[K.BLOCK]))
        .when(decided == K.ALLOW, F.lit(CUSTOMER_COPY[K.ALLOW]))
        .otherwise(F.lit(CUSTOMER_COPY[K.STEP_UP]))
    )
