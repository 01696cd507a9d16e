from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_decide import KEY, request, requests, signals_for
from test_publish import T0, log_frame, random_log, row

from riskweave.functions.accounts import Pseudonymiser
from riskweave.operators import signals
from riskweave.sources import shared
from riskweave.streaming import ingest
from riskweave.streaming.decide import TransferDesk
from riskweave.streaming.publish import SignalStore


def land(spark, df, base):
    """Write rows as a file source and land them through a streaming query."""
    df.write.mode("append").parquet(f"{base}/source")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/source")
    ingest.land_signals(stream, f"{base}/landed", f"{base}/progress").awaitTermination()
    return ingest.landed(spark.read.parquet(f"{base}/landed"))


@pytest.mark.parametrize("quota", [None, 2])
def test_steps_equal_one_batch(spark, quota):
    rows = random_log(5, 300)
    log = log_frame(spark, rows)
    valid = signals.valid_signals(log)
    batch = signals.classify_publishes(valid, quota).select("seq", "outcome")
    base = shared.fresh_dir(spark, "stream")
    store = SignalStore(spark, f"{base}/store")
    for start, end in ((0, 99), (100, 180), (181, 299)):
        landed = land(spark, log.filter(F.col("seq").between(start, end)), base)
        store.advance(landed, quota)
        assert store.advance(landed, quota) is None
    want = {r.seq: r.outcome for r in batch.collect()}
    assert {r.seq: r.outcome for r in store.outcomes().collect()} == want
    taken = signals.accepted(signals.classify_publishes(valid, quota))
    assert store.current().count() == signals.current_signals(taken).count()
    quarantined = ingest.landed(spark.read.parquet(f"{base}/landed")).filter(F.size("violations") > 0)
    assert quarantined.count() == len(rows) - len(want)


def test_rows_that_land_late_get_an_outcome(spark):
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'stream')}/store")
    # Accounts by seq: 1 and 4 share one, 2 and 5 another.
    rows = [row(i, 90, account="abcabd"[i - 1], ttl=100) for i in range(1, 7)]
    log = signals.with_violations(log_frame(spark, rows)).withColumn("seq", F.col("seq") + 1)
    for seen in ((1, 2, 5), (1, 2, 5, 3, 4), (1, 2, 3, 4, 5, 6)):
        before = {r.seq for r in store.outcomes().collect()}
        assert store.advance(log.filter(F.col("seq").isin(*seen))) == max(set(seen) - before)
    got = {r.seq: r.outcome for r in store.outcomes().collect()}
    assert got == {i: "accepted" for i in range(1, 7)}


def test_a_late_row_with_an_older_assessment_is_stale(spark):
    store = SignalStore(spark, f"{shared.fresh_dir(spark, 'stream')}/store")
    rows = [row(1, 90, ttl=100), row(2, 80, ttl=100), row(3, 70, ttl=100)]
    log = signals.with_violations(log_frame(spark, rows))
    for seen in ((0, 2), (0, 1, 2)):
        store.advance(log.filter(F.col("seq").isin(*seen)))
    assert {r.seq: r.outcome for r in store.outcomes().collect()} == {0: "accepted", 1: "stale", 2: "accepted"}


def test_requests_that_land_late_are_decided(spark):
    base = shared.fresh_dir(spark, "stream")
    pseudonymiser = Pseudonymiser.from_key(spark, KEY)
    taken = signals.accepted(signals.classify_publishes(signals_for(spark, [row(1, 92, "BANK-B", "b")])))
    desk, rows = TransferDesk(spark, f"{base}/desk"), [request(i, 2, "ACC-b") for i in range(1, 7)]
    for seen in ((1, 2, 5), (1, 2, 5, 3, 4), (1, 2, 3, 4, 5, 6)):
        named = pseudonymiser.with_risk_id(requests(spark, [rows[i - 1] for i in seen]), "receiver_account").drop("account_norm")
        assert desk.advance(named, taken) == max(seen)
    got = {r.transfer_id: r.decision for r in desk.audit().collect()}
    assert got == {f"txn-{i:05d}": "block" for i in range(1, 7)} and desk.audit().count() == 6


def test_compaction_keeps_the_replay_guard_and_frees_slots(spark):
    base = shared.fresh_dir(spark, "stream")
    store = SignalStore(spark, f"{base}/store")
    first = [row(0, 90, account="a", ttl=2), row(1, 90, account="b", ttl=100)]
    log = signals.with_violations(log_frame(spark, first))
    assert store.advance(log, quota=2) == 1
    store.compact(F.lit(T0 + timedelta(hours=3)).cast("timestamp_ntz"))
    store.compact(F.lit(T0 + timedelta(hours=3)).cast("timestamp_ntz"))
    assert [r.risk_id[0] for r in store.current().collect()] == ["b"]
    assert store.marks().count() == 2
    more = first + [
        row(4, 95, account="a", ttl=100, stamp=0),
        row(5, 50, account="c"),
        row(6, 50, account="d"),
        row(7, 10, account="b"),
    ]
    store.advance(signals.with_violations(log_frame(spark, more)), quota=2)
    got = {r.seq: r.outcome for r in store.outcomes().collect()}
    assert got == {
        0: "accepted", 1: "accepted", 2: "stale", 3: "accepted", 4: "quota_exceeded", 5: "accepted"
    }


def test_uncommitted_version_is_invisible_and_replaced(spark):
    base = shared.fresh_dir(spark, "stream")
    store = SignalStore(spark, f"{base}/store")
    log = signals.with_violations(log_frame(spark, [row(0), row(1, account="b")]))
    store.advance(log, upto=0)
    # A step that died after its first write leaves files without a commit marker.
    broken = log_frame(spark, [row(9)]).withColumn("outcome", F.lit("accepted"))
    store.tables.write("outcomes", 1, broken, "arrival_ts")
    assert store.outcomes().count() == 1
    assert store.advance(log) == 1
    assert sorted(r.seq for r in store.outcomes().collect()) == [0, 1]


def test_transfers_are_decided_once(spark):
    base = shared.fresh_dir(spark, "stream")
    pseudonymiser = Pseudonymiser.from_key(spark, KEY)
    log = [row(1, 92, "BANK-B", "b"), row(5, 0, "BANK-B", "b")]
    taken = signals.accepted(signals.classify_publishes(signals_for(spark, log)))
    desk = TransferDesk(spark, f"{base}/desk")

    def step(rows):
        frame = requests(spark, rows)
        frame.write.mode("append").parquet(f"{base}/source")
        stream = spark.readStream.schema(frame.schema).parquet(f"{base}/source")
        ingest.land_transfers(stream, pseudonymiser, f"{base}/landed", f"{base}/progress").awaitTermination()
        return desk.advance(ingest.landed(spark.read.parquet(f"{base}/landed")), taken)

    assert step([request(1, 2, "ACC-b", txn="txn-same"), request(2, 3, "!!")]) == 1
    assert step([request(3, 6, "ACC-b", txn="txn-same"), request(4, 6, "ACC-b"), request(5, 6, "ACC-b", txn="txn-same")]) == 5
    got = {r.transfer_id: r.decision for r in desk.audit().collect()}
    assert got == {"txn-same": "block", "txn-00004": "allow"} and desk.audit().count() == 2
    assert desk.advance(ingest.landed(spark.read.parquet(f"{base}/landed")), taken) is None
