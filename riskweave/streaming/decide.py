"""Deciding landed transfers in steps, each transfer once."""

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import constants as K
from riskweave.functions import timecols
from riskweave.functions.policy import PolicyConfig, PolicyVersions
from riskweave.operators import lookup, transfers
from riskweave.operators.skew import ROWS_PER_TASK, HotKeys, join_to_unique, touching
from riskweave.streaming.ingest import BATCH
from riskweave.streaming.publish import SignalStore
from riskweave.streaming.versions import BUCKETS, Change, Commit, StepStore

_POLICY = T.StructType(
    [
        T.StructField("step_up_at", T.IntegerType()),
        T.StructField("block_at", T.IntegerType()),
        T.StructField("step_up_above_amount_minor", T.LongType()),
        T.StructField("min_confidence_to_block", T.DoubleType()),
        T.StructField("min_banks_to_block", T.IntegerType()),
        T.StructField("on_bus_unavailable", T.StringType()),
    ]
)
_AUDIT = T.StructType(
    [
        *[
            T.StructField(c, T.StringType())
            for c in ("transfer_id", "user_ref", "bank_id", "receiver_account")
        ],
        T.StructField("amount_minor", T.LongType()),
        *[
            T.StructField(c, T.StringType())
            for c in ("currency", "risk_id", "decision", "lookup_status")
        ],
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("reason_codes", T.ArrayType(T.StringType())),
        T.StructField("contributing_banks", T.ArrayType(T.StringType())),
        T.StructField("model_version", T.StringType()),
        T.StructField("policy", _POLICY),
        T.StructField("decided_at", T.TimestampNTZType()),
    ]
)


_IDS = T.StructType([T.StructField("transfer_id", T.StringType()), T.StructField("last_request", T.LongType())])
#: Rows of one Bloom filter in the audit files: a look-up by reference skips row groups without it.
_BLOOM = {"parquet.bloom.filter.enabled#transfer_id": "true", "parquet.bloom.filter.expected.ndv#transfer_id": "1000000"}


def _merge_ids(runs: DataFrame) -> DataFrame:
    return runs.groupBy("transfer_id").agg(F.max("last_request").alias("last_request"))


def _change(ids: DataFrame) -> Change:
    return Change("ids", ids, "transfer_id", _IDS, _merge_ids)


def visible_range(first_request: object, last_request: object) -> tuple[object, object]:
    """Arrivals that can be live for, and visible to, a request in the given time range."""
    return first_request - timedelta(hours=K.MAX_TTL_HOURS, minutes=K.MAX_CLOCK_SKEW_MINUTES), last_request


def recent_signals(accepted: DataFrame, first_request: object, last_request: object) -> DataFrame:
    oldest, newest = visible_range(first_request, last_request)
    between = [F.lit(t).cast("timestamp_ntz") for t in (oldest, newest)]
    return accepted.filter(F.col("arrival_ts").between(*between))


@dataclass(frozen=True)
class TransferDesk:
    """Audit records of all decided transfers, a version for each step.

    Retries are recognised by an index of the ids with their last request, in buckets, so a step reads
    neither the audit nor the landing batches of earlier steps. With a `horizon`, an id is known until that
    long after its last request: a later one is a new transfer, decided and audited anew. `forget` drops ids past
    the horizon; one that lands after its id was forgotten is new as well. Without a horizon ids are kept for ever.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    horizon: timedelta | None = None

    @property
    def tables(self) -> StepStore:
        return StepStore(self.spark, self.path, self.buckets)

    def audit(self) -> DataFrame:
        """All audit records; `decided_at_on` is the day the files are divided by."""
        return self.tables.history("audit", _AUDIT, "decided_at")

    def _new_requests(self, valid: DataFrame, state: Commit, hot: HotKeys | None) -> DataFrame:
        """Requests that are no retries, of unfolded rows."""
        tables = self.tables
        at = timecols.micros(F.col("request_ts"))
        horizon = None if self.horizon is None else self.horizon // timedelta(microseconds=1)
        known = tables.read(state.of("ids"), _IDS, tables.touched(valid, "transfer_id", state))
        known = _merge_ids(touching(known, valid, ["transfer_id"]))
        if horizon is None:
            return join_to_unique(valid, known, ["transfer_id"], "left_anti", hot, ["seq"])
        joined = join_to_unique(valid, known, ["transfer_id"], "left", hot, ["seq"])
        return joined.filter(F.col("last_request").isNull() | (at - F.col("last_request") > horizon)).drop("last_request")

    def advance(
        self,
        landed: DataFrame,
        accepted: DataFrame | SignalStore,
        policies: PolicyVersions | None = None,
        outages: DataFrame | None = None,
        rows_per_task: int = ROWS_PER_TASK,
    ) -> int | None:
        """Decide the landed requests that are new, in whatever order they landed.

        `accepted` is the accepted log, or the store that holds it, of which only the days in question are
        read. Returns the highest `seq` landed, or None when nothing was left to decide.
        """
        tables = self.tables
        before = tables.last()
        valid = landed.filter(F.col("account_reject").isNull()).drop("account_reject")
        folded: list[int] = []
        if BATCH in landed.columns:
            valid = valid.filter(before.unfolded(F.col(BATCH)))
            folded = valid.agg(F.collect_set(BATCH)).first()[0]
            valid = valid.drop(BATCH)
        hot_ids = transfers.hot_transfer_ids(valid, rows_per_task)
        new = self._new_requests(valid, before, hot_ids)
        first_request, last_request, end = new.agg(F.min("request_ts"), F.max("request_ts"), F.max("seq")).first()
        if end is None and not folded:
            return None
        state = before.next()
        if end is not None:
            fresh = transfers.first_requests(new)
            if isinstance(accepted, SignalStore):
                signals = accepted.accepted_between(*visible_range(first_request, last_request))
            else:
                signals = recent_signals(accepted, first_request, last_request)
            history = lookup.SignalHistory(
                signals,
                signals.select("risk_id", "source_bank_id"),
                lookup.hot_accounts(new, signals, rows_per_task),
            )
            seen = lookup.with_lookup_status(lookup.risk_at_transfer(fresh, history), outages)
            rules = policies or PolicyVersions.single(PolicyConfig())
            decided = transfers.audit_records(transfers.apply_policy(seen, rules))
            tables.write("audit", state.version, decided, "decided_at", **_BLOOM)
        ids = valid.select("transfer_id", timecols.micros(F.col("request_ts")).alias("last_request"))
        state = tables.add(state, [_change(_merge_ids(ids))])
        tables.commit(state.with_folded(folded))
        return None if end is None else valid.agg(F.max("seq")).first()[0]

    def forget(self, as_of: Column) -> None:
        """Merge the index of ids into one run, without those whose horizon ended before `as_of`."""
        tables = self.tables
        before = tables.last()
        if self.horizon is None or not before.runs:
            return
        ids = _merge_ids(tables.read(before.of("ids"), _IDS))
        oldest = timecols.micros(as_of) - (self.horizon // timedelta(microseconds=1))
        known = ids.filter(F.col("last_request") >= oldest)
        tables.commit(tables.replace_all(before.next(), [_change(known)]))
