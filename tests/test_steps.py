"""Steps over landing batches: what they read, how state is merged, what a dead step leaves behind."""

import glob
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_decide import KEY, request, requests, signals_for
from test_publish import T0, log_frame, random_log, row

from riskweave.functions.accounts import Pseudonymiser
from riskweave.operators import retention, signals, trust
from riskweave.sources import derived, shared
from riskweave.streaming import ingest, versions
from riskweave.streaming.decide import TransferDesk
from riskweave.streaming.publish import SignalStore
from riskweave.streaming.versions import CLOCK_STEP_BACK, Commit


class Feed:
    """A file source and the query that lands it."""

    def __init__(self, spark, ring=None):
        self.spark, self.ring = spark, ring
        self.base = shared.fresh_dir(spark, "feed")

    def land(self, df, pseudonymiser=None):
        df.write.mode("append").parquet(f"{self.base}/source")
        stream = self.spark.readStream.schema(df.schema).parquet(f"{self.base}/source")
        at = f"{self.base}/landed", f"{self.base}/progress"
        query = (
            ingest.land_signals(stream, *at, self.ring)
            if pseudonymiser is None
            else ingest.land_transfers(stream, pseudonymiser, *at)
        )
        query.awaitTermination()
        read = ingest.admitted_signals if pseudonymiser is None else ingest.admitted_transfers
        return read(self.spark, f"{self.base}/landed")

    def quarantined(self):
        return ingest.quarantined(self.spark, f"{self.base}/landed")


def spoil(spark, *folders):
    """Make the Parquet files of some folders unreadable; a later read of them fails."""
    spoiled = 0
    for folder in folders:
        for path in glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True):
            with open(path, "wb") as f:
                f.write(b"spoiled")
            crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
            if os.path.exists(crc):
                with open(crc, "wb") as f:
                    f.write(b"")
            spoiled += 1
    assert spoiled
    spark.catalog.clearCache()


def outcomes_of(store):
    return {r.seq: r.outcome for r in store.outcomes().collect()}


def test_a_step_reads_no_file_of_folded_batches(spark):
    feed = Feed(spark)
    store = SignalStore(spark, f"{feed.base}/store")
    parts = [[row(0), row(1, account="b")], [row(2, account="b"), row(3, account="a")]]
    log = log_frame(spark, parts[0] + parts[1])
    first = feed.land(log.filter("seq < 2"))
    assert store.advance(first) == 1
    assert store.advance(first) is None
    # Marks and current signals of the same accounts are state; what was landed or decided is history.
    spoil(spark, f"{feed.base}/landed/fate=admitted", f"{feed.base}/store/outcomes")
    second = feed.land(log.filter("seq >= 2"))
    assert store.advance(second) == 3
    written = store.tables.written("outcomes", 1, store.outcomes().schema)
    assert {r.seq: r.outcome for r in written.collect()} == {2: "accepted", 3: "accepted"}
    with pytest.raises(Exception, match="(?i)parquet|CANNOT_READ"):
        store.outcomes().collect()


def test_a_step_reads_only_the_buckets_of_its_accounts(spark):
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'store')}/store", buckets=64)
    log = signals.with_violations(log_frame(spark, [row(i, account="abcdef01"[i]) for i in range(8)]))
    assert store.advance(log.withColumn(ingest.BATCH, F.lit(1).cast("long"))) == 7
    last = store.tables.last()
    new = log_frame(spark, [row(9, account="a")])
    own = store.tables.touched(new, "risk_id", last)
    assert len(own) == 1
    others = [
        f
        for table in ("marks", "current")
        for f in glob.glob(f"{store.path.removeprefix('file:')}/{table}/run=*/__bucket=*")
        if not f.endswith(f"={own[0]}")
    ]
    spoil(spark, *others)
    landed = signals.with_violations(log_frame(spark, [row(0, account="a", stamp=-5), row(9, account="a")]))
    numbered = landed.withColumn("seq", F.col("seq") + 20).withColumn(ingest.BATCH, F.lit(2).cast("long"))
    assert store.advance(numbered) == 21
    got = outcomes_of(store)
    assert (got[20], got[21]) == ("stale", "accepted")


@pytest.mark.parametrize("quota", [None, 3])
def test_landing_batches_out_of_order(spark, quota):
    """Every landing is judged by what was stored when it landed, as one log in landing order would be."""
    rows = random_log(11, 240)
    log = log_frame(spark, rows)
    feed = Feed(spark)
    store = SignalStore(spark, f"{feed.base}/store")
    step = F.floor(F.col("seq") / 20) % 3
    for k in range(3):
        store.advance(feed.land(log.filter(step == k)), quota)
    # Marks ignore arrival between steps, so the order of landing is the order of judging.
    want, marks, held = {}, {}, {}
    valid = signals.valid_signals(log).withColumn("step", step)
    for r in valid.orderBy("step", "arrival_ts", "seq").collect():
        pair = (r.risk_id, r.source_bank_id)
        effective = min(r.timestamp, r.arrival_ts)
        if r.arrival_ts >= r.timestamp + timedelta(hours=r.ttl_hours):
            want[r.seq] = "expired"
        elif pair in marks and effective <= marks[pair]:
            want[r.seq] = "stale"
        elif quota is not None and pair not in marks and held.get(pair[1], 0) >= quota:
            want[r.seq] = "quota_exceeded"
        else:
            want[r.seq] = "accepted"
            held[pair[1]] = held.get(pair[1], 0) + (pair not in marks)
            marks[pair] = effective
    assert outcomes_of(store) == want
    assert {r.source_bank_id: r.accounts_held for r in store.holdings().collect() if r.accounts_held} == held
    assert {(r.risk_id, r.source_bank_id): r.mark for r in store.marks().collect()} == marks


def test_levels_keep_the_runs_few(spark, monkeypatch):
    monkeypatch.setattr(versions, "FANOUT", 2)
    rows = [row(i, account="abc"[i % 3], score=i) for i in range(9)]
    log = signals.with_violations(log_frame(spark, rows))
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'store')}/store", buckets=2)
    for i in range(9):
        store.advance(log.filter(F.col("seq") == i).withColumn(ingest.BATCH, F.lit(i).cast("long")))
        runs = store.tables.last().of("current")
        # As a binary counter: one run per binary digit of the number of steps.
        assert sorted(r.level for r in runs) == [b for b in range(4) if (i + 1) >> b & 1]
    assert {r.risk_id[0]: r.risk_score for r in store.current().collect()} == {"a": 6, "b": 7, "c": 8}
    assert sum(r.accounts_held for r in store.holdings().collect()) == 3
    # The commits of nine steps are two rows.
    assert spark.read.parquet(f"{store.path}/commit/even", f"{store.path}/commit/odd").count() == 2


def test_a_dead_commit_leaves_the_last_one(spark):
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'store')}/store")
    log = signals.with_violations(log_frame(spark, [row(i, account="abc"[i]) for i in range(3)]))
    batch = {i: log.filter(F.col("seq") == i).withColumn(ingest.BATCH, F.lit(i).cast("long")) for i in range(3)}
    store.advance(batch[0])
    store.advance(batch[1])
    # The third step replaced the first commit's folder, and died before its row was there.
    spark.range(0).select(F.col("id").alias("version")).write.mode("overwrite").parquet(f"{store.path}/commit/even")
    assert store.tables.last().version == 1
    assert sorted(outcomes_of(store)) == [0, 1]
    assert store.advance(batch[1]) is None
    assert store.advance(batch[2]) == 2
    assert sorted(outcomes_of(store)) == [0, 1, 2]


def test_batches_numbered_while_the_clock_was_set_back():
    state = Commit().with_folded([10, 30])
    assert (state.folded_to, state.folded_since) == (-1, (10, 30))
    late = state.with_folded([CLOCK_STEP_BACK + 20])
    # 10 is past; 30 is listed; a batch between them is still to be folded.
    assert (late.folded_to, late.folded_since) == (20, (30, CLOCK_STEP_BACK + 20))


def test_unfolded_is_by_number(spark):
    state = Commit(folded_to=20, folded_since=(30, 50))
    got = spark.range(60).filter(state.unfolded(F.col("id"))).collect()
    assert [r.id for r in got] == [i for i in range(21, 60) if i not in (30, 50)]


def test_compaction_evicts_the_least_valuable_and_frees_slots(spark):
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'store')}/store")
    rows = [row(i, 10 * i, account="abcdef"[i], ttl=50) for i in range(6)]
    log = signals.with_violations(log_frame(spark, rows))
    numbered = log.withColumn(ingest.BATCH, F.col("seq"))
    assert store.advance(numbered.filter("seq < 5"), quota=5) == 4
    as_of = F.lit(T0 + timedelta(hours=6)).cast("timestamp_ntz")
    want = retention.enforce_capacity(store.current(), as_of, 2).select("risk_id").collect()
    store.compact(as_of, max_accounts=2)
    assert {r.risk_id[0] for r in store.current().collect()} == {r.risk_id[0] for r in want} == {"d", "e"}
    assert [r.accounts_held for r in store.holdings().collect()] == [2]
    # The slots are free, but a replay of an evicted signal stays out.
    replay = [row(7, 99, account="a", ttl=50, stamp=0), row(8, 99, account="f", ttl=50)]
    more = signals.with_violations(log_frame(spark, replay)).withColumn("seq", F.col("seq") + 50)
    store.advance(more.withColumn(ingest.BATCH, F.lit(77).cast("long")), quota=3)
    got = outcomes_of(store)
    assert (got[50], got[51]) == ("stale", "accepted")


def test_forged_and_revoked_rows_land_in_quarantine(spark):
    ring = derived.publishers(spark)
    sent = log_frame(spark, [row(i, 80, bank=b, account="abcd"[i]) for i, b in enumerate(("BANK-A", "BANK-E", "BANK-E", "BANK-A"))])
    # BANK-E is revoked from the 15th to the 18th; row 2 arrives then. Row 3 was changed on the way.
    sent = sent.withColumn("arrival_ts", F.when(F.col("seq") == 2, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")).otherwise(F.col("arrival_ts")))
    sent = sent.withColumn("timestamp", F.col("arrival_ts"))
    keys = derived.key_ring(spark).filter("key_id LIKE '%/1'").withColumn("source_bank_id", F.substring_index("key_id", "/", 1))
    tagged = sent.join(keys, "source_bank_id").withColumn("tag", trust.payload_tag(F.col("inner_pad"), F.col("outer_pad")))
    tagged = tagged.drop("key_id", "inner_pad", "outer_pad")
    tagged = tagged.withColumn("risk_score", F.when(F.col("seq") == 3, 0).otherwise(F.col("risk_score")))
    feed = Feed(spark, ring)
    store = SignalStore(spark, f"{feed.base}/store")
    store.advance(feed.land(tagged))
    assert outcomes_of(store) == {0: "accepted", 1: "accepted"}
    why = {r.seq: r.integrity for r in feed.quarantined().collect()}
    assert why == {2: trust.UNKNOWN_PUBLISHER, 3: trust.SIGNATURE_INVALID}


def test_transfer_steps_read_no_history(spark):
    feed, pseudonymiser = Feed(spark), Pseudonymiser.from_key(spark, KEY)
    taken = signals.accepted(signals.classify_publishes(signals_for(spark, [row(1, 92, "BANK-B", "b")])))
    desk = TransferDesk(spark, f"{feed.base}/desk")
    assert desk.advance(feed.land(requests(spark, [request(1, 2, "ACC-b", txn="txn-same")]), pseudonymiser), taken) == 1
    spoil(spark, f"{feed.base}/landed/fate=admitted", f"{feed.base}/desk/audit")
    more = [request(3, 6, "ACC-b", txn="txn-same"), request(4, 6, "ACC-b"), request(5, 3, "!!")]
    landed = feed.land(requests(spark, more), pseudonymiser)
    assert desk.advance(landed, taken) == 4
    assert desk.advance(landed, taken) is None
    written = desk.tables.written("audit", 1, desk.audit().schema)
    assert [r.transfer_id for r in written.collect()] == ["txn-00004"]


def test_a_retry_after_the_horizon_is_a_new_transfer(spark):
    desk = TransferDesk(spark, f"{shared.fresh_dir(spark, 'desk')}/desk", horizon=timedelta(hours=5))
    pseudonymiser = Pseudonymiser.from_key(spark, KEY)
    taken = signals.accepted(signals.classify_publishes(signals_for(spark, [row(1, 92, "BANK-B", "b")])))

    def step(*rows):
        named = pseudonymiser.with_risk_id(requests(spark, list(rows)), "receiver_account").drop("account_norm")
        return desk.advance(named.withColumn(ingest.BATCH, F.lit(rows[0][0]).cast("long")), taken)

    step(request(1, 2, "ACC-b", txn="txn-same"))
    # Within five hours of the last request, each time: a retry.
    assert step(request(2, 6, "ACC-b", txn="txn-same")) is None
    assert step(request(3, 11, "ACC-b", txn="txn-same")) is None
    step(request(4, 17, "ACC-b", txn="txn-same"))
    when = sorted(r.decided_at for r in desk.audit().collect())
    assert when == [T0 + timedelta(hours=2), T0 + timedelta(hours=17)]
    desk.forget(F.lit(T0 + timedelta(hours=30)).cast("timestamp_ntz"))
    assert desk.tables.read(desk.tables.last().of("ids"), desk.tables.read([], desk.audit().schema).select("transfer_id").schema).count() == 0


def test_desk_reads_the_days_in_question_from_the_store(spark):
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'store')}/store")
    log = signals.with_violations(signals_for(spark, [row(1, 92, "BANK-B", "b", ttl=100), row(500, 10, "BANK-B", "b")]))
    store.advance(log.withColumn(ingest.BATCH, F.lit(1).cast("long")))
    late = glob.glob(f"{store.path.removeprefix('file:')}/outcomes/version=0/arrival_ts_on=*")
    assert len(late) == 2
    spoil(spark, max(late))
    desk = TransferDesk(spark, f"{store.path}/desk")
    named = Pseudonymiser.from_key(spark, KEY).with_risk_id(requests(spark, [request(1, 2, "ACC-b")]), "receiver_account")
    assert desk.advance(named.drop("account_norm").withColumn(ingest.BATCH, F.lit(1).cast("long")), store) == 1
    assert [r.decision for r in desk.audit().collect()] == ["block"]
