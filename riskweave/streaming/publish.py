"""Folding landed signals into the stored state of the signal network.

State is a set of runs (`versions`): marks merge by MAX, current signals by newest arrival, holdings by
sum. These merges may be done in any order, so a step writes only what its rows changed. A step reads the
landing batches that no step has folded and the buckets of state that their accounts touch: its work does not
grow with the history.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import retention, signals
from riskweave.operators.skew import ROWS_PER_TASK, touching
from riskweave.sources.shared import checkpointed
from riskweave.streaming.ingest import BATCH
from riskweave.streaming.versions import BUCKETS, Change, Commit, StepStore

_PAIR = ["risk_id", "source_bank_id"]
_MARKS = T.StructType(
    [
        T.StructField("risk_id", T.StringType()),
        T.StructField("source_bank_id", T.StringType()),
        T.StructField("mark", T.TimestampNTZType()),
    ]
)
_HOLDINGS = T.StructType(
    [T.StructField("source_bank_id", T.StringType()), T.StructField("accounts_held", T.LongType())]
)
_OUTCOMES = T.StructType([*signals.SIGNAL_SCHEMA.fields, T.StructField("outcome", T.StringType())])
_CURRENT = signals.SIGNAL_SCHEMA


def _merge_marks(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*_PAIR).agg(F.max("mark").alias("mark"))


def _merge_current(runs: DataFrame) -> DataFrame:
    return signals.current_signals(runs).select(*_CURRENT.names)


def _merge_holdings(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_bank_id").agg(F.sum("accounts_held").alias("accounts_held"))


def _changes(marks: DataFrame, current: DataFrame, holdings: DataFrame) -> list[Change]:
    return [
        Change("marks", marks, "risk_id", _MARKS, _merge_marks),
        Change("current", current, "risk_id", _CURRENT, _merge_current),
        Change("holdings", holdings, "source_bank_id", _HOLDINGS, _merge_holdings),
    ]


@dataclass(frozen=True)
class SignalStore:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @property
    def tables(self) -> StepStore:
        return StepStore(self.spark, self.path, self.buckets)

    def outcomes(self) -> DataFrame:
        """Every folded row with its outcome: what publishers are told."""
        return self.tables.history("outcomes", _OUTCOMES, "arrival_ts").drop("arrival_ts_on")

    def accepted(self) -> DataFrame:
        return signals.accepted(self.outcomes())

    def accepted_between(self, oldest: object, newest: object) -> DataFrame:
        """Accepted signals that arrived in a time range: the files of other days are not read."""
        first, last = (F.lit(t).cast("timestamp_ntz") for t in (oldest, newest))
        rows = self.tables.history("outcomes", _OUTCOMES, "arrival_ts")
        days = F.col("arrival_ts_on").between(F.lit(oldest).cast("date"), F.lit(newest).cast("date"))
        return signals.accepted(rows.filter(days & F.col("arrival_ts").between(first, last)).drop("arrival_ts_on"))

    def current(self) -> DataFrame:
        return _merge_current(self.tables.read(self.tables.last().of("current"), _CURRENT))

    def marks(self) -> DataFrame:
        return _merge_marks(self.tables.read(self.tables.last().of("marks"), _MARKS))

    def holdings(self) -> DataFrame:
        """Accounts held by each bank."""
        return _merge_holdings(self.tables.read(self.tables.last().of("holdings"), _HOLDINGS))

    def state_for(self, new: DataFrame, state: Commit | None = None) -> signals.StoreState | None:
        """The state that concerns the pairs of `new`: only their buckets are read."""
        tables = self.tables
        state = state or tables.last()
        if not state.runs:
            return None
        buckets = tables.touched(new, "risk_id", state)
        marks = touching(tables.read(state.of("marks"), _MARKS, buckets), new, _PAIR)
        current = touching(tables.read(state.of("current"), _CURRENT, buckets).select(*_PAIR), new, _PAIR)
        held = tables.read(state.of("holdings"), _HOLDINGS)
        return signals.StoreState(_merge_marks(marks), current.distinct(), _merge_holdings(held))

    def _unfolded(self, landed: DataFrame, state: Commit, upto: int | None) -> DataFrame:
        """Valid landed rows that no step has folded. Landed tables tell by their batch; other rows
        (for instance a repaired extract) are compared with all outcomes by `seq`."""
        rows = landed.filter(F.size("violations") == 0)
        if upto is not None:
            rows = rows.filter(F.col("seq") <= upto)
        if BATCH in landed.columns:
            return rows.filter(state.unfolded(F.col(BATCH))).select(*_CURRENT.names, BATCH)
        return rows.join(self.outcomes().select("seq"), "seq", "left_anti").select(*_CURRENT.names)

    def advance(
        self,
        landed: DataFrame,
        quota: int | None = None,
        upto: int | None = None,
        rows_per_task: int = ROWS_PER_TASK,
    ) -> int | None:
        """Fold the valid landed rows (through `upto`) that no earlier step has folded, in whatever
        order they landed. A row that lands late is judged against the marks stored by then, so one
        with an older assessment than a folded row of its pair is stale; a row that lands twice is a replay.

        Returns the highest `seq` folded, or None without new rows. Batches are folded whole: `upto`
        is for rows without a batch.
        """
        if upto is not None and BATCH in landed.columns:
            raise ValueError("landing batches are folded whole")
        tables = self.tables
        before = tables.last()
        new = self._unfolded(landed, before, upto)
        batches = F.collect_set(BATCH) if BATCH in new.columns else F.array()
        end, folded = new.agg(F.max("seq"), batches).first()
        if end is None:
            return None
        new = new.select(*_CURRENT.names)
        state = before.next()
        hot = signals.hot_pairs(new, rows_per_task)
        known = self.state_for(new, before)
        classified = signals.classify_publishes(new, quota, hot, known)
        tables.write("outcomes", state.version, classified.select(*_OUTCOMES.names), "arrival_ts")
        accepted = signals.accepted(tables.written("outcomes", state.version, _OUTCOMES))
        taken = accepted.select(*_PAIR).distinct()
        if known is not None:
            taken = taken.join(known.held, _PAIR, "left_anti")
        high = signals.high_water(accepted).select(*_MARKS.names)
        changes = _changes(high, _merge_current(accepted), retention.holdings(taken))
        tables.commit(tables.add(state, changes).with_folded(folded))
        return end

    def compact(self, as_of: Column, max_accounts: int | None = None) -> None:
        """Merge all runs into one, without expired signals, without marks that can no longer matter and,
        with `max_accounts`, without the least valuable accounts beyond it. Slots of what left are free again;
        the marks of evicted accounts stay, so that a replay cannot bring them back."""
        tables = self.tables
        before = tables.last()
        if not before.runs:
            return
        state = before.next()
        marks = signals.keep_useful_marks(self.marks(), as_of).select(*_MARKS.names)
        if max_accounts is None:
            current = retention.purge_expired(self.current(), as_of)
        else:
            current = retention.enforce_capacity(self.current(), as_of, max_accounts)
        current = checkpointed(current.select(*_CURRENT.names))
        tables.commit(tables.replace_all(state, _changes(marks, current, retention.holdings(current))))
