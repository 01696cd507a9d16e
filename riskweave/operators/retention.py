"""What the store and the audit table keep."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import timecols
from riskweave.functions import constants as K
from riskweave.operators.selection import RankFinder, at_or_before
from riskweave.sources.shared import checkpointed


def _live(as_of: Column) -> Column:
    return timecols.is_live(as_of, timecols.expires_at(F.col("timestamp"), F.col("ttl_hours")))


def purge_expired(current: DataFrame, as_of: Column) -> DataFrame:
    return current.filter(_live(as_of))


def purge_counts(current: DataFrame, as_of: Column) -> DataFrame:
    """Signals and accounts before a purge, and the accounts that vanish with it."""
    accounts = current.groupBy("risk_id").agg(
        F.count(F.lit(1)).alias("signals"), F.max(_live(as_of)).alias("survives")
    )
    return accounts.agg(
        F.coalesce(F.sum("signals"), F.lit(0)).cast("bigint").alias("signals"),
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(~F.col("survives")).alias("accounts_removed"),
    )


def account_values(current: DataFrame) -> DataFrame:
    """Value of each account to the store: highest score, then latest of its earliest expiries."""
    expiry = timecols.expires_at(F.col("timestamp"), F.col("ttl_hours"))
    return current.groupBy("risk_id").agg(
        F.max("risk_score").alias("max_score"), F.min(expiry).alias("min_expires_at")
    )


def most_valuable_accounts(
    current: DataFrame, as_of: Column, max_accounts: int = K.DEFAULT_MAX_ACCOUNTS
) -> DataFrame:
    """The accounts a full store keeps after expired signals were purged.

    This is the true top of one snapshot: an admission that evicts one account at a time would
    always keep the newcomer.
    """
    values = account_values(purge_expired(current, as_of))
    ranked = values.withColumns(
        {
            "__score": -F.col("max_score").cast("bigint"),
            "__expiry": -timecols.micros(F.col("min_expires_at")),
        }
    )
    # One row per account, read again for the result.
    ranked = checkpointed(ranked)
    order = ["__score", "__expiry", "risk_id"]
    finder = RankFinder(ranked, order)
    last = finder.keys_at({None: [max_accounts]}).get((None, max_accounts))
    kept = ranked if last is None else ranked.filter(at_or_before(order, last))
    return kept.drop("__score", "__expiry")


def enforce_capacity(
    current: DataFrame, as_of: Column, max_accounts: int = K.DEFAULT_MAX_ACCOUNTS
) -> DataFrame:
    kept = most_valuable_accounts(current, as_of, max_accounts).select("risk_id")
    return purge_expired(current, as_of).join(kept, "risk_id", "left_semi")


def holdings(current: DataFrame) -> DataFrame:
    """Accounts held by each bank."""
    return current.groupBy("source_bank_id").agg(F.count(F.lit(1)).alias("accounts_held"))


def store_size(current: DataFrame) -> DataFrame:
    return current.agg(F.count_distinct("risk_id").alias("accounts"))


@dataclass(frozen=True)
class RetainedAudit:
    kept: DataFrame
    archived: DataFrame
    dropped: int


def retain_audit(audit: DataFrame, capacity: int = K.DEFAULT_AUDIT_CAPACITY) -> RetainedAudit:
    """Split an audit table into its newest `capacity` records and the rest, which is archived
    rather than lost, with the number of records that left."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    keyed = audit.withColumn("__newest", -timecols.micros(F.col("decided_at")))
    order = ["__newest", "transfer_id"]
    finder = RankFinder(keyed, order)
    total = finder.counts.get(None, 0)
    last = finder.keys_at({None: [capacity]}).get((None, capacity))
    if last is None:
        return RetainedAudit(audit, audit.filter(F.lit(False)), 0)
    recent = at_or_before(order, last)
    return RetainedAudit(
        keyed.filter(recent).drop("__newest"),
        keyed.filter(~recent).drop("__newest"),
        max(total - capacity, 0),
    )
