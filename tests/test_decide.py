import random
from datetime import timedelta

import pytest
from fold import Store
from pyspark.sql import functions as F
from test_publish import T0, log_frame, random_log, row

from riskweave.functions.accounts import Pseudonymiser
from riskweave.functions.policy import PolicyConfig, PolicyVersions
from riskweave.operators import lookup, signals, transfers
from riskweave.plans.decide import decide_transfers
from riskweave.sources import shared
from riskweave.sources.audit import append_audit, read_audit

KEY = b"public test key, thirty-two byte"
SCHEMA = (
    "seq bigint, request_ts timestamp_ntz, transfer_id string, user_ref string, bank_id string, "
    "receiver_account string, amount_minor bigint, currency string"
)


def request(seq, hours, account="ACC-999", amount=500_000, txn=None):
    at = T0 + timedelta(hours=hours)
    return (seq, at, txn or f"txn-{seq:05d}", "mira", "BANK-A", account, amount, "INR")


def requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def signals_for(spark, rows):
    """Log rows whose `risk_id` stands for an account name."""
    pseudonymiser = Pseudonymiser.from_key(spark, KEY)
    log = log_frame(spark, rows).withColumn("risk_id", F.concat(F.lit("ACC-"), F.substring("risk_id", 1, 1)))
    return log.withColumn("risk_id", pseudonymiser.risk_id(F.col("risk_id")))


def decided(spark, asked, log, **options):
    return decide_transfers(
        requests(spark, asked), signals_for(spark, log), Pseudonymiser.from_key(spark, KEY), **options
    )


def by_id(audit):
    return {r.transfer_id: r for r in audit.collect()}


def test_scenario(spark):
    log = [row(1, 92, "BANK-B", "b"), row(5, 10, "BANK-B", "b"), row(6, 60, "BANK-C", "b")]
    asked = [
        request(1, 0.5, "ACC-b"),
        request(2, 1, " acc-b "),
        request(3, 5.5, "ACC-B"),
        request(4, 7, "ACC-b"),
        request(5, 29, "ACC-b"),
        request(6, 2, "ACC-clean"),
        request(7, 2, "ACC-clean", 10_000_001),
        request(8, 2, "!!"),
    ]
    d = decided(spark, asked, log)
    got = by_id(d.audit)
    assert {k: (r.decision, r.lookup_status, r.risk_score) for k, r in got.items()} == {
        "txn-00001": ("allow", "not_found", None),
        "txn-00002": ("block", "found", 92),
        "txn-00003": ("allow", "found", 10),
        "txn-00004": ("step_up", "found", 60),
        "txn-00005": ("step_up", "found", 60),
        "txn-00006": ("allow", "not_found", None),
        "txn-00007": ("step_up", "not_found", None),
    }
    assert got["txn-00004"].contributing_banks == ["BANK-B", "BANK-C"]
    assert got["txn-00005"].contributing_banks == ["BANK-C"]
    assert got["txn-00001"].reason_codes == [] and got["txn-00002"].policy.block_at == 85
    assert d.audit.columns == transfers.AUDIT_COLUMNS
    assert [r.transfer_id for r in d.quarantined.collect()] == ["txn-00008"]


def test_retries_get_the_first_decision(spark):
    log = [row(1, 92, "BANK-B", "b"), row(5, 0, "BANK-B", "b")]
    asked = [request(1, 2, "ACC-b", txn="txn-same"), request(2, 6, "ACC-b", txn="txn-same")]
    for rows_per_task in (1, 10**6):
        d = decided(spark, asked, log, rows_per_task=rows_per_task)
        assert d.audit.count() == 1
        assert [tuple(r) for r in d.responses.select("decision", "audit_ref").collect()] == [
            ("block", "txn-same")
        ] * 2


def test_customer_sees_three_columns(spark):
    d = decided(spark, [request(1, 2, "ACC-b")], [row(1, 92, "BANK-B", "b")])
    assert d.responses.columns == ["decision", "user_message", "audit_ref"]


@pytest.mark.parametrize("more", [0, 150])
@pytest.mark.parametrize("limit", [10**6, 0])
def test_an_outage_without_end_never_fails_open(spark, monkeypatch, limit, more):
    monkeypatch.setattr(lookup, "BROADCAST_PIECES", limit)
    old = [(T0 - timedelta(hours=i + 2), T0 - timedelta(hours=i + 1)) for i in range(more)]
    outages = spark.createDataFrame([(T0 + timedelta(hours=2), None), *old], "start_ts timestamp_ntz, end_ts timestamp_ntz")
    asked = [request(1, 1, "ACC-b"), request(2, 3, "ACC-b"), request(3, 300, "ACC-none")]
    got = by_id(decided(spark, asked, [row(1, 99, "BANK-B", "b")], outages=outages).audit)
    assert [got[f"txn-{i:05d}"].lookup_status for i in (1, 2, 3)] == ["found", "unavailable", "unavailable"]
    assert [got[f"txn-{i:05d}"].decision for i in (2, 3)] == ["step_up", "step_up"]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_outage_is_not_a_clean_account(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_PIECES", limit)
    outages = spark.createDataFrame(
        [(T0 + timedelta(hours=2), T0 + timedelta(hours=3.5))] * 2
        + [(T0 + timedelta(hours=3), T0 + timedelta(hours=4))],
        "start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    asked = [request(i, h, "ACC-b") for i, h in enumerate((1.99, 2, 3.4, 3.99, 4))]
    log = [row(1, 20, "BANK-B", "b")]
    got = by_id(decided(spark, asked, log, outages=outages).audit)
    status = [got[f"txn-{i:05d}"].lookup_status for i in range(5)]
    assert status == ["found", "unavailable", "unavailable", "unavailable", "found"]
    down = got["txn-00001"]
    assert down.decision == "step_up" and down.risk_score is None and down.contributing_banks == []
    strict = PolicyVersions.single(PolicyConfig(on_bus_unavailable="block"))
    got = by_id(decided(spark, asked, log, outages=outages, policies=strict).audit)
    assert got["txn-00001"].decision == "block" and got["txn-00000"].decision == "allow"


@pytest.mark.parametrize("rows_per_task", [15, 10**6])
def test_lookup_equals_sequential_fold(spark, rows_per_task):
    log = random_log(11, 500)
    rng = random.Random(5)
    moments = sorted(rng.uniform(0, 300) for _ in range(300))
    # Most requests ask for one account; some fall exactly on an arrival.
    asked = [
        request(
            i,
            (log[i]["arrival_ts"] - T0) / timedelta(hours=1) if i % 5 == 0 else h,
            f"ACC-{'a' if i % 3 else rng.choice('abcdefg')}",
        )
        for i, h in enumerate(moments)
    ]
    pseudonymiser = Pseudonymiser.from_key(spark, KEY)
    got = by_id(decided(spark, asked, log, rows_per_task=rows_per_task).audit)
    valid = [r for r in log if r["timestamp"] <= r["arrival_ts"] + timedelta(minutes=5)]
    steps = sorted(
        [(r["arrival_ts"], 0, i, r) for i, r in enumerate(valid)]
        + [(a[1], 1, a[0], a) for a in asked],
        key=lambda s: s[:3],
    )
    store, checked = Store(), 0
    for at, kind, _, what in steps:
        if kind == 0:
            store.publish(what)
            continue
        score, banks = store.lookup(what[5][-1] * 64, at)
        found = got[what[2]]
        assert (found.risk_score, found.contributing_banks) == (score, banks), what
        checked += score is not None
    assert checked > 50
    assert pseudonymiser


def test_account_risk_and_ties(spark):
    rows = [
        row(0, 80, "BANK-A", "a"), row(1, 80, "BANK-B", "a"), row(1, 0, "BANK-C", "a"),
        row(0, 99, "BANK-D", "a", ttl=1), row(0, 99, "BANK-A", "b", ttl=1),
    ]
    current = signals.current_signals(signals.accepted(signals.classify_publishes(log_frame(spark, rows))))
    asked = spark.createDataFrame([(c * 64,) for c in "abc"], "risk_id string")
    as_of = F.lit(T0 + timedelta(hours=2)).cast("timestamp_ntz")
    got = {r.risk_id[0]: r for r in lookup.lookup(asked, current, as_of).collect()}
    assert got["a"].source_bank_id == "BANK-B" and got["a"].lookup_status == "found"
    assert got["a"].contributing_banks == ["BANK-A", "BANK-B", "BANK-C"]
    assert got["b"].lookup_status == got["c"].lookup_status == "not_found"


def test_audit_round_trip_and_evidence(spark):
    log = [row(1, 92, "BANK-B", "b")]
    d = decided(spark, [request(1, 2, "ACC-b"), request(2, 3, "ACC-x")], log)
    path = shared.fresh_dir(spark, "test-audit")
    append_audit(d.audit, path)
    append_audit(decided(spark, [request(3, 30, "ACC-b")], log).audit, path)
    stored = read_audit(spark, path)
    assert sorted(stored.columns) == sorted(transfers.AUDIT_COLUMNS) and stored.count() == 3
    again = requests(spark, [request(1, 2, "ACC-b"), request(9, 2, "ACC-b")])
    assert [r.transfer_id for r in transfers.undecided(again, stored).collect()] == ["txn-00009"]

    current = signals.current_signals(signals.accepted(signals.classify_publishes(signals_for(spark, log))))
    refs = spark.createDataFrame([("txn-00001",), ("txn-00002",)], "audit_ref string")
    for hours, status in ((3, "found"), (30, "not_found")):
        as_of = F.lit(T0 + timedelta(hours=hours)).cast("timestamp_ntz")
        seen = by_id(transfers.evidence(refs, stored, current, as_of))
        assert seen["txn-00001"].risk_score == 92 and seen["txn-00001"].status_now == status
        assert seen["txn-00002"].status_now == "not_found"
