"""The publish log of risk signals: validation, outcome of each publish, state of the store.

A log row has the signal fields plus `arrival_ts` and `seq` (unique, gives log order within one
instant). "Now" is the arrival of the row, never the wall clock.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import checks, timecols
from riskweave.functions import constants as K
from riskweave.operators import scans
from riskweave.operators.barrier import computed_once
from riskweave.operators.selection import RankFinder
from riskweave.operators.skew import ROWS_PER_TASK, HotKeys, find_hot_keys

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("arrival_ts", T.TimestampNTZType()),
        T.StructField("risk_id", T.StringType()),
        T.StructField("source_bank_id", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason_codes", T.ArrayType(T.StringType())),
        T.StructField("model_version", T.StringType()),
        T.StructField("ttl_hours", T.IntegerType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)
_PAIR = ["risk_id", "source_bank_id"]


def parse_signal_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """Typed log rows from JSON text (`seq`, `arrival_ts`, body), with the unknown field names.

    A value of the wrong type becomes NULL and is then refused by the field's own rule. A missing
    TTL takes the default; a missing timestamp is the arrival.
    """
    shape = (
        "risk_id string, risk_score string, confidence string, reason_codes array<string>, "
        "model_version string, source_bank_id string, ttl_hours string, timestamp string"
    )
    s = F.from_json(F.col(body), shape)
    present = F.json_object_keys(F.col(body))
    ttl = F.when(
        F.array_contains(present, "ttl_hours"), s["ttl_hours"].try_cast("int")
    ).otherwise(F.lit(K.DEFAULT_TTL_HOURS))
    stamp = F.when(
        F.array_contains(present, "timestamp"), timecols.utc_from_offset_text(s["timestamp"])
    ).otherwise(F.col("arrival_ts"))
    return raw.select(
        "seq",
        "arrival_ts",
        s["risk_id"].alias("risk_id"),
        s["source_bank_id"].alias("source_bank_id"),
        s["risk_score"].try_cast("int").alias("risk_score"),
        s["confidence"].try_cast("double").alias("confidence"),
        s["reason_codes"].alias("reason_codes"),
        s["model_version"].alias("model_version"),
        ttl.alias("ttl_hours"),
        stamp.alias("timestamp"),
        checks.unknown_json_fields(F.col(body), K.SIGNAL_FIELDS).alias("unknown_fields"),
    )


def _rules(log: DataFrame) -> checks.Rules:
    return checks.signal_rules(F.col("unknown_fields") if "unknown_fields" in log.columns else None)


def with_violations(log: DataFrame) -> DataFrame:
    """Add `violations`: the names of the rules a row breaks."""
    return log.withColumn("violations", checks.violations(_rules(log)))


def valid_signals(log: DataFrame) -> DataFrame:
    checked = computed_once(log.withColumn("__valid", checks.all_hold(_rules(log))), "signals-checked")
    return checked.filter("__valid").drop("__valid", "unknown_fields")


def quarantined_signals(log: DataFrame) -> DataFrame:
    return with_violations(log).filter(F.size("violations") > 0)


def expired_on_arrival() -> Column:
    expiry = timecols.expires_at(F.col("timestamp"), F.col("ttl_hours"))
    return ~timecols.is_live(F.col("arrival_ts"), expiry)


def publisher_quota(
    max_accounts: int = K.DEFAULT_MAX_ACCOUNTS, share: float = K.DEFAULT_PUBLISHER_SHARE
) -> int:
    """How many accounts one bank may hold."""
    if max_accounts < 1:
        raise ValueError("max_accounts must be positive")
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    return max(1, int(max_accounts * share))


@dataclass(frozen=True)
class StoreState:
    """What earlier runs left behind, at least for the pairs of the new rows.

    marks: `mark`, newest accepted effective time of each (`risk_id`, `source_bank_id`). held: the
    pairs in the store. holdings: accounts held by each bank in the whole store (`accounts_held`).
    """

    marks: DataFrame
    held: DataFrame
    holdings: DataFrame


def hot_pairs(log: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> HotKeys | None:
    return find_hot_keys(log, _PAIR, F.col("arrival_ts"), rows_per_task)


def _with_earlier_mark(log: DataFrame, state: StoreState | None) -> DataFrame:
    """Add `__before`, the pair's high-water mark from earlier runs."""
    if state is None:
        return log.withColumn("__before", F.lit(None).cast("timestamp_ntz"))
    return log.join(state.marks.select(*_PAIR, F.col("mark").alias("__before")), _PAIR, "left")


def _may_land() -> Column:
    """Neither expired nor a replay of what earlier runs accepted."""
    effective = timecols.effective_time(F.col("timestamp"), F.col("arrival_ts"))
    replayed = F.coalesce(effective <= F.col("__before"), F.lit(False))
    return ~expired_on_arrival() & ~replayed


def _first_publishes(log: DataFrame, state: StoreState | None) -> DataFrame:
    """First publish that may land of each (bank, account) not held yet: a request for a slot."""
    first = F.min(F.struct(timecols.micros(F.col("arrival_ts")).alias("at"), "seq"))
    slots = _with_earlier_mark(log, state).filter(_may_land()).groupBy(*_PAIR).agg(first.alias("f"))
    slots = slots.select(*_PAIR, F.col("f.at").alias("at"), F.col("f.seq").alias("seq"))
    if state is not None:
        slots = slots.join(state.held.select(*_PAIR), _PAIR, "left_anti")
    return slots


def last_slots(log: DataFrame, quota: int, state: StoreState | None = None) -> DataFrame | None:
    """For every bank over its quota, the arrival (`last_at`, `last_seq`) that took its last slot.

    `last_at` is NULL for a bank whose slots were all taken before. None if no bank is over.
    """
    finder = RankFinder(_first_publishes(log, state), ["at", "seq"], group="source_bank_id")
    held: dict[str, int] = {}
    if state is not None:
        held = {r["source_bank_id"]: r["accounts_held"] for r in state.holdings.collect()}
    free = {bank: max(0, quota - held.get(bank, 0)) for bank in finder.counts}
    over = [bank for bank, n in finder.counts.items() if n > free[bank]]
    if not over:
        return None
    keys = finder.keys_at({bank: [free[bank]] for bank in over})
    rows = [(bank, *keys.get((bank, free[bank]), (None, None))) for bank in over]
    return log.sparkSession.createDataFrame(
        rows, "source_bank_id string, last_at bigint, last_seq bigint"
    )


def classify_publishes(
    log: DataFrame,
    quota: int | None = None,
    hot: HotKeys | None = None,
    state: StoreState | None = None,
) -> DataFrame:
    """Add `outcome` to every log row: expired, stale, quota_exceeded or accepted.

    The high-water mark of a (account, bank) pair is the running maximum of the effective times
    before the row: a stale row never exceeds it, so stale rows need not be told apart. All rows
    of the pair share one shuffle; pairs named in `hot` are cut into time chunks.

    With a quota, a bank's new accounts are admitted in arrival order until its slots are full;
    slots are not released within one run.
    """
    effective = timecols.effective_time(F.col("timestamp"), F.col("arrival_ts"))
    lands = _may_land()
    values = [scans.Running("__mark", F.when(lands, effective), inclusive=False)]
    limits = last_slots(log, quota, state) if quota is not None else None
    if limits is not None:
        arrival = F.struct(
            timecols.micros(F.col("arrival_ts")).alias("at"), F.col("seq").alias("seq")
        )
        values.append(scans.Running("__first", F.when(lands, arrival), kind="min"))
    earlier = _with_earlier_mark(log, state)
    rows = scans.running(earlier, _PAIR, "arrival_ts", ["seq"], values, hot)

    refused = F.lit(False)
    if limits is not None:
        # One row per bank over quota; the number of member banks bounds it.
        rows = rows.join(
            F.broadcast(limits.withColumn("__over", F.lit(True))), "source_bank_id", "left"
        )
        last = F.struct(F.col("last_at").alias("at"), F.col("last_seq").alias("seq"))
        full = F.coalesce(F.col("__over"), F.lit(False))
        refused = full & (F.col("last_at").isNull() | (F.col("__first") > last))
        if state is not None:
            held = state.held.select(*_PAIR, F.lit(True).alias("__held"))
            rows = rows.join(held, _PAIR, "left")
            refused = refused & F.col("__held").isNull()
    # A refused pair never moved its mark, so its later rows are refused, not stale.
    outcome = (
        F.when(expired_on_arrival(), F.lit(K.EXPIRED))
        .when(~lands, F.lit(K.STALE))
        .when(F.coalesce(refused, F.lit(False)), F.lit(K.QUOTA_EXCEEDED))
        .when(F.coalesce(effective <= F.col("__mark"), F.lit(False)), F.lit(K.STALE))
        .otherwise(F.lit(K.ACCEPTED))
    )
    return rows.select(*log.columns, outcome.alias("outcome"))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("outcome") == K.ACCEPTED).drop("outcome")


def high_water(accepted_log: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest accepted effective time per pair.

    With `as_of`, marks older than the longest TTL are left out: whatever they would call stale
    has expired by then, so no replay gets through.
    """
    effective = timecols.effective_time(F.col("timestamp"), F.col("arrival_ts"))
    marks = accepted_log.groupBy(*_PAIR).agg(F.max(effective).alias("mark"))
    return marks if as_of is None else keep_useful_marks(marks, as_of)


def keep_useful_marks(marks: DataFrame, as_of: Column) -> DataFrame:
    return marks.filter(F.col("mark") > as_of - F.make_dt_interval(F.lit(0), F.lit(K.MAX_TTL_HOURS)))


def current_signals(accepted_log: DataFrame) -> DataFrame:
    """The newest accepted signal of each (account, bank); a later lower score replaces a higher."""
    payload = [c for c in accepted_log.columns if c not in _PAIR]
    order = F.struct("arrival_ts", "seq")
    newest = accepted_log.groupBy(*_PAIR).agg(
        F.max_by(F.struct(*payload), order).alias("newest")
    )
    return newest.select(*_PAIR, "newest.*")
