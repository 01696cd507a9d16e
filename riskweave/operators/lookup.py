"""Risk of an account, now or as it was known at the moment of a transfer."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import timecols
from riskweave.functions import constants as K
from riskweave.operators import scans
from riskweave.operators.skew import (
    ROWS_PER_TASK,
    HotKeys,
    find_hot_keys,
    join_to_unique,
)

_EVIDENCE = ["risk_score", "timestamp", "source_bank_id", "confidence", "reason_codes", "model_version"]
# Pieces of outages (one per outage and hour) up to which they are broadcast.
BROADCAST_PIECES = 1_000_000


def _worst(condition: Column | None = None) -> Column:
    """Highest score, then the newest assessment, then the bank name to make ties definite."""
    evidence = F.struct(*_EVIDENCE)
    return F.max(evidence if condition is None else F.when(condition, evidence))


def _rollup(worst: str) -> list[Column]:
    return [F.col(f"{worst}.{name}").alias(name) for name in _EVIDENCE]


def account_risk(current: DataFrame, as_of: Column) -> DataFrame:
    """Live risk per account: the worst signal and every bank that holds a live one."""
    expiry = timecols.expires_at(F.col("timestamp"), F.col("ttl_hours"))
    live = current.filter(timecols.is_live(as_of, expiry))
    return (
        live.groupBy("risk_id")
        .agg(
            _worst().alias("worst"),
            F.array_sort(F.collect_set("source_bank_id")).alias("contributing_banks"),
        )
        .select("risk_id", *_rollup("worst"), "contributing_banks")
    )


def lookup(accounts: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Join requested accounts (`risk_id`) to their live risk, with found / not_found."""
    found = accounts.join(account_risk(current, as_of), "risk_id", "left")
    return found.withColumn("lookup_status", found_status(F.col("risk_score")))


def found_status(score: Column) -> Column:
    return F.when(score.isNotNull(), F.lit(K.FOUND)).otherwise(F.lit(K.NOT_FOUND))


@dataclass(frozen=True)
class SignalHistory:
    """Accepted signals for point-in-time lookups.

    `pairs` names at least every (`risk_id`, `source_bank_id`) of `accepted`; repeats do no harm.
    It is kept apart because it needs no outcome: taking it from the validated log spares the
    shuffle that classifies the log a second time. `hot` lists accounts to be split.
    """

    accepted: DataFrame
    pairs: DataFrame
    hot: HotKeys | None = None


def hot_accounts(
    transfers: DataFrame, log: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> HotKeys | None:
    """Accounts heavy in either table, over the time range of both."""
    moments = transfers.select("risk_id", F.col("request_ts").alias("at")).unionAll(
        log.select("risk_id", F.col("arrival_ts").alias("at"))
    )
    return find_hot_keys(moments, ["risk_id"], F.col("at"), rows_per_task)


def risk_at_transfer(transfers: DataFrame, history: SignalHistory) -> DataFrame:
    """Add to each transfer the live risk of `risk_id` as known at `request_ts`.

    `transfer_id` must be unique. Instead of comparing a transfer with every signal of its account,
    transfers are merged into the signal history of each (account, bank) and take the newest signal
    before them: the work is linear in the rows, whatever the number of signals per account. A
    signal that arrives at the very instant of the request is visible.
    """
    hot = history.hot
    arrivals = history.accepted.select(
        "risk_id",
        "source_bank_id",
        F.col("arrival_ts").alias("at"),
        F.lit(0).alias("kind"),
        "seq",
        F.lit(None).cast("string").alias("transfer_id"),
        F.struct(
            "arrival_ts",
            "seq",
            timecols.expires_at(F.col("timestamp"), F.col("ttl_hours")).alias("expires_at"),
            *_EVIDENCE,
        ).alias("signal"),
    )
    # The banks of an account are a subset of the member banks, so the set stays small.
    banks = history.pairs.groupBy("risk_id").agg(F.collect_set("source_bank_id").alias("banks"))
    asked = join_to_unique(
        transfers.select("risk_id", "request_ts", "transfer_id"),
        banks,
        ["risk_id"],
        "inner",
        hot,
        ["transfer_id"],
    ).select(
        "risk_id",
        F.explode("banks").alias("source_bank_id"),
        F.col("request_ts").alias("at"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("bigint").alias("seq"),
        "transfer_id",
    )
    merged = arrivals.unionByName(asked, allowMissingColumns=True)
    newest = scans.running(
        merged,
        ["risk_id", "source_bank_id"],
        "at",
        ["kind", "seq"],
        [scans.Running("newest", F.col("signal"))],
        hot,
    )
    visible = newest.filter(
        (F.col("kind") == 1) & timecols.is_live(F.col("at"), F.col("newest.expires_at"))
    ).select("transfer_id", "newest.*")
    risk = (
        visible.groupBy("transfer_id")
        .agg(
            _worst().alias("worst"),
            F.array_sort(F.collect_set("source_bank_id")).alias("contributing_banks"),
        )
        .select("transfer_id", *_rollup("worst"), "contributing_banks")
    )
    return transfers.join(risk, "transfer_id", "left").withColumn(
        "contributing_banks",
        F.coalesce("contributing_banks", F.array().cast("array<string>")),
    )


def with_lookup_status(risk: DataFrame, outages: DataFrame | None = None) -> DataFrame:
    """Add `lookup_status`. During an outage (`start_ts` <= request < `end_ts`) the answer is
    unavailable, whatever the store held, and carries no evidence. An outage without an end goes on, one
    without a start was always there; a request without a time is in none."""
    status = found_status(F.col("risk_score"))
    if outages is None:
        return risk.withColumn("lookup_status", status)
    marked = _outage_by_slot(risk, outages.select("start_ts", "end_ts").distinct())
    status = F.when(F.col("__down"), F.lit(K.UNAVAILABLE)).otherwise(status)
    hidden = {
        c: F.when(~F.col("__down"), F.col(c)) for c in (*_EVIDENCE,) if c in risk.columns
    }
    hidden["contributing_banks"] = F.when(
        F.col("__down"), F.array().cast("array<string>")
    ).otherwise(F.col("contributing_banks"))
    return marked.withColumn("lookup_status", status).withColumns(hidden).drop("__down")


def _outage_by_slot(risk: DataFrame, windows: DataFrame) -> DataFrame:
    """Outages are cut into the hours of the requests' time range, merged there, and joined by hour."""
    hour = 3_600_000_000
    now = timecols.micros(F.col("request_ts"))
    first, last = risk.agg(F.min(now), F.max(now)).first()
    if first is None:
        return risk.withColumn("__down", F.lit(False))
    pieces = (
        windows.select(
            F.greatest(F.coalesce(timecols.micros(F.col("start_ts")), F.lit(first)), F.lit(first)).alias("__from"),
            F.least(F.coalesce(timecols.micros(F.col("end_ts")), F.lit(last + 1)), F.lit(last + 1)).alias("__to"),
        )
        .filter("__from < __to")
        .withColumn(
            "__slot",
            F.explode(
                F.sequence(F.floor(F.col("__from") / hour), F.floor((F.col("__to") - 1) / hour))
            ),
        )
    )
    cut = pieces.select(
        "__slot",
        F.greatest(F.col("__from") - F.col("__slot") * hour, F.lit(0)).alias("f"),
        F.least(F.col("__to") - F.col("__slot") * hour, F.lit(hour)).alias("t"),
    )
    slots = _unions(cut).groupBy("__slot").agg(F.collect_list(F.struct("f", "t")).alias("__windows"))
    asked = risk.withColumns({"__slot": F.floor(now / hour), "__at": F.pmod(now, F.lit(hour))})
    if pieces.count() <= BROADCAST_PIECES:
        joined = asked.join(F.broadcast(slots), "__slot", "left")
    else:  # an hour with many requests is split by salt
        joined = join_to_unique(asked, slots, ["__slot"], "left", find_hot_keys(asked, ["__slot"]), ["transfer_id"])
    down = F.exists(
        F.col("__windows"), lambda w: (w["f"] <= F.col("__at")) & (F.col("__at") < w["t"])
    )
    return joined.withColumn("__down", F.coalesce(down, F.lit(False))).drop(
        "__slot", "__at", "__windows"
    )


def _unions(cut: DataFrame) -> DataFrame:
    """Overlapping and adjoining pieces (`f`, `t`) of an hour joined: an hour then has as many as it has
    gaps, whatever the number of its outages. Of pieces with one start only the longest is sorted."""
    longest = cut.groupBy("__slot", "f").agg(F.max("t").alias("t"))
    order = Window.partitionBy("__slot").orderBy("f")
    reached = F.max("t").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.coalesce(reached, F.lit(-1)) < F.col("f")).cast("int")
    numbered = longest.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(order))
    return numbered.groupBy("__slot", "__island").agg(F.min("f").alias("f"), F.max("t").alias("t"))
