import random
from datetime import datetime, timedelta

import pytest
from fold import Store
from pyspark.sql import functions as F

from riskweave.functions import timecols
from riskweave.operators import scans, signals
from riskweave.operators.skew import find_hot_keys
from riskweave.plans.publish import publish

T0 = datetime(2024, 1, 1)


def log_frame(spark, rows):
    full = [
        (
            i, r["arrival_ts"], r["risk_id"], r["source_bank_id"], r["risk_score"], r.get("confidence", 0.9),
            ["high_velocity"], "v1", r["ttl_hours"], r["timestamp"],
        )
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, signals.SIGNAL_SCHEMA)


def row(hours, score=90, bank="BANK-A", account="a", ttl=24, stamp=None):
    at = T0 + timedelta(hours=hours)
    return {
        "arrival_ts": at,
        "risk_id": account * 64,
        "source_bank_id": bank,
        "risk_score": score,
        "ttl_hours": ttl,
        "timestamp": at if stamp is None else T0 + timedelta(hours=stamp),
    }


def outcomes(spark, rows, **options):
    got = signals.classify_publishes(log_frame(spark, rows), **options)
    return [r.outcome for r in got.orderBy("seq").collect()]


def random_log(seed, n=600, accounts="abcdef", banks=4):
    rng = random.Random(seed)
    rows, hour = [], 0.0
    for _ in range(n):
        hour += rng.choice([0, 0, 0.05, 0.5, 2])
        stamp = hour - rng.choice([0, 0, 0, -0.05, 0.1, 3, 30])
        # Two thirds of all rows belong to one pair.
        hot = rng.random() < 0.66
        account = "a" if hot else rng.choice(accounts)
        bank = "BANK-A" if hot else f"BANK-{rng.choice('ABCD'[:banks])}"
        rows.append(row(hour, rng.randint(0, 100), bank, account, rng.randint(1, 48), stamp))
    return rows


def test_downward_revision_is_accepted(spark):
    assert outcomes(spark, [row(0, 92), row(1, 10)]) == ["accepted", "accepted"]


def test_replay_is_stale_even_at_the_same_time(spark):
    rows = [row(1), row(2, 10), row(3, 90, stamp=1), row(4, 95, stamp=2), row(4, 96)]
    assert outcomes(spark, rows) == ["accepted", "accepted", "stale", "stale", "accepted"]


def test_expired_does_not_move_the_mark(spark):
    rows = [row(30, ttl=1, stamp=28), row(31, ttl=24, stamp=20)]
    assert outcomes(spark, rows) == ["expired", "accepted"]


def test_future_stamp_cannot_reserve_the_slot(spark):
    rows = [row(0, 5, stamp=0.06), row(0.01, 95)]
    assert outcomes(spark, rows) == ["accepted", "accepted"]


def test_quota_rejects_new_accounts_only(spark):
    rows = [row(i, account=a) for i, a in enumerate("abcdef")] + [row(10, 1, account="a")]
    got = outcomes(spark, rows, quota=3)
    assert got == ["accepted"] * 3 + ["quota_exceeded"] * 3 + ["accepted"]


def test_one_bank_cannot_use_up_the_quota_of_another(spark):
    rows = [row(i, account=a) for i, a in enumerate("abcdef")] + [row(9, bank="BANK-B", account="f")]
    assert outcomes(spark, rows, quota=2)[-1] == "accepted"


def test_quota_size():
    assert signals.publisher_quota(100_000, 0.25) == 25_000
    assert signals.publisher_quota(1, 0.1) == 1
    for bad in ((0, 0.5), (10, 0.0), (10, 1.5)):
        with pytest.raises(ValueError):
            signals.publisher_quota(*bad)


@pytest.mark.parametrize("quota", [None, 1, 2])
@pytest.mark.parametrize("split_hot", [False, True])
def test_equals_sequential_fold(spark, quota, split_hot):
    rows = random_log(7)
    store = Store(quota)
    want = [store.publish(r) for r in rows]
    log = log_frame(spark, rows)
    hot = find_hot_keys(log, ["risk_id", "source_bank_id"], F.col("arrival_ts"), 20) if split_hot else None
    assert (hot is not None) == split_hot
    got = signals.classify_publishes(log, quota, hot)
    assert [r.outcome for r in got.orderBy("seq").collect()] == want
    assert set(want) >= {"accepted", "stale", "expired"}
    if quota:
        assert "quota_exceeded" in want

    taken = signals.accepted(got)
    current = {(r.risk_id, r.source_bank_id): r.seq for r in signals.current_signals(taken).collect()}
    assert current == {k: rows.index(s) for k, s in store.signals.items()}
    marks = {(r.risk_id, r.source_bank_id): r.mark for r in signals.high_water(taken).collect()}
    assert marks == store.marks


def test_pruned_marks_let_no_replay_through(spark):
    rows = [row(0, ttl=168), row(200, ttl=168, account="b")]
    taken = signals.accepted(signals.classify_publishes(log_frame(spark, rows)))
    as_of = F.lit(T0 + timedelta(hours=200)).cast("timestamp_ntz")
    kept = signals.high_water(taken, as_of).collect()
    assert [r.risk_id[0] for r in kept] == ["b"]
    assert outcomes(spark, [row(200, ttl=168, stamp=0)]) == ["expired"]


def test_publish_quarantines_broken_rows(spark):
    rows = [row(0), {**row(1), "risk_score": 300}, row(2, stamp=9)]
    result = publish(log_frame(spark, rows))
    assert result.accepted.count() == 1
    bad = {r.seq: r.violations for r in result.quarantined.collect()}
    assert bad == {1: ["risk_score_range"], 2: ["timestamp_future"]}


def test_a_burst_is_cut_into_like_parts(spark):
    # All but one of a pair's rows arrive within one second.
    rows = spark.range(20_000).select(
        F.lit("a").alias("k"),
        F.when(F.col("id") == 0, F.lit("2020-01-01").cast("timestamp_ntz"))
        .otherwise(F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id / 20000)"))
        .alias("at"),
        "id",
    )
    hot = find_hot_keys(rows, ["k"], F.col("at"), rows_per_task=1000)
    now = timecols.micros(F.col("at"))
    sizes = hot.mark(rows).groupBy(F.size(F.filter("__cuts", lambda c: c < now)).alias("c")).count().collect()
    assert max(r["count"] for r in sizes) <= 2000
    got = scans.running(rows, ["k"], "at", ["id"], [scans.Running("top", F.col("id"), inclusive=False)], hot)
    plain = scans.running(rows, ["k"], "at", ["id"], [scans.Running("top", F.col("id"), inclusive=False)])
    assert got.exceptAll(plain).count() == 0 and got.count() == 20_000
