import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.functions import money
from riskweave.operators import signals, transfers

NOW = datetime(2024, 3, 1, 12, 0, 0)
SIGNAL = {
    "risk_id": "a" * 64,
    "risk_score": 92,
    "confidence": 0.9,
    "reason_codes": ["high_velocity"],
    "model_version": "v0.4-x",
    "source_bank_id": "BANK-B",
    "ttl_hours": 24,
    "timestamp": "2024-03-01T12:00:00Z",
}


def signal_cases():
    yield {}, []
    yield {"risk_score": 0}, []
    yield {"risk_score": 100, "confidence": 1.0, "ttl_hours": 168}, []
    yield {"ttl_hours": -5}, ["ttl_range"]
    yield {"ttl_hours": 0}, ["ttl_range"]
    yield {"ttl_hours": 169}, ["ttl_range"]
    yield {"risk_score": -1}, ["risk_score_range"]
    yield {"risk_score": 101}, ["risk_score_range"]
    yield {"risk_score": "high"}, ["risk_score_range"]
    yield {"confidence": "NaN"}, ["confidence_range"]
    yield {"confidence": 1.0001}, ["confidence_range"]
    for bad in ("A" * 64, "a" * 63, "g" * 64, "a" * 64 + "\n"):
        yield {"risk_id": bad}, ["risk_id_format"]
    for bad in ("bad code", "x;y", "c" * 50, "1abc", "UPPER"):
        yield {"reason_codes": [bad]}, ["reason_code_format"]
    yield {"reason_codes": ["mule_account", "mule_account"]}, ["reason_codes_duplicate"]
    yield {"reason_codes": []}, ["reason_codes_count"]
    yield {"reason_codes": [f"code_{i}" for i in range(50)]}, ["reason_codes_count"]
    yield {"reason_codes": ["own_vocabulary"]}, []
    yield {"source_bank_id": "bank-b"}, ["bank_id_format"]
    yield {"source_bank_id": "B" * 40}, ["bank_id_format"]
    yield {"model_version": "no spaces"}, ["model_version_format"]
    yield {"timestamp": "2025-03-01T12:00:00Z"}, ["timestamp_future"]
    yield {"timestamp": "2024-03-01T12:05:00Z"}, []
    yield {"timestamp": "2024-03-01T17:35:00+05:30"}, []
    yield {"timestamp": "2024-03-01T17:35:00.000001+05:30"}, ["timestamp_future"]
    yield {"timestamp": "2024-03-01T12:00:00"}, ["timestamp_missing"]
    yield {"owner": "someone"}, ["unknown_field"]


def test_signal_rules(spark):
    cases = list(signal_cases())
    raw = spark.createDataFrame(
        [(i, NOW, json.dumps({**SIGNAL, **change})) for i, (change, _) in enumerate(cases)],
        "seq bigint, arrival_ts timestamp_ntz, body string",
    )
    got = signals.with_violations(signals.parse_signal_json(raw)).select("seq", "violations")
    found = {r.seq: r.violations for r in got.collect()}
    for i, (change, want) in enumerate(cases):
        assert found[i] == want, change


def test_missing_fields_and_defaults(spark):
    def without(*names):
        return json.dumps({k: v for k, v in SIGNAL.items() if k not in names})

    raw = spark.createDataFrame(
        [(0, NOW, without("ttl_hours", "timestamp")), (1, NOW, without("risk_score", "reason_codes"))],
        "seq bigint, arrival_ts timestamp_ntz, body string",
    )
    parsed = signals.with_violations(signals.parse_signal_json(raw)).orderBy("seq").collect()
    assert parsed[0].violations == [] and parsed[0].ttl_hours == 24 and parsed[0].timestamp == NOW
    assert "risk_score_range" in parsed[1].violations
    assert "reason_codes_count" in parsed[1].violations


def test_offsets_do_not_depend_on_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        body = json.dumps({**SIGNAL, "timestamp": "2024-03-10T02:30:00-05:00"})
        raw = spark.createDataFrame([(1, body)], "seq bigint, body string").withColumn(
            "arrival_ts", F.lit("2024-03-11 00:00:00").cast("timestamp_ntz")
        )
        assert signals.parse_signal_json(raw).first().timestamp == datetime(2024, 3, 10, 7, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


TRANSFER = ("pay-00731", "mira", "BANK-A", "ACC-999", 500_000, "INR")


def transfer_cases():
    def change(**kw):
        names = ("transfer_id", "user_ref", "bank_id", "receiver_account", "amount_minor", "currency")
        return tuple(kw.get(n, v) for n, v in zip(names, TRANSFER))

    yield change(), []
    yield change(user_ref="  mira "), []
    yield change(amount_minor=10**15), []
    for bad in (0, -5000, 10**16, None):
        yield change(amount_minor=bad), ["amount_range"]
    for c in ("\n", "\r", "\x7f", "\x85", "\u2028", "\u2029", "\u202e"):
        yield change(user_ref=f"a{c}b"), ["user_ref_charset"]
    yield change(user_ref=" \t "), ["user_ref_blank"]
    yield change(user_ref=""), ["user_ref_length", "user_ref_blank"]
    yield change(user_ref="u" * 65), ["user_ref_length"]
    yield change(bank_id="B" * 33), ["bank_id_length"]
    yield change(transfer_id="pay-073"), ["transfer_id_length"]
    yield change(receiver_account="!!"), []
    yield change(currency="inr"), ["currency_format"]
    yield change(currency="INR\n"), ["currency_format"]


def test_transfer_rules(spark):
    cases = list(transfer_cases())
    rows = [(i, NOW + timedelta(seconds=i), *values) for i, (values, _) in enumerate(cases)]
    df = spark.createDataFrame(
        rows,
        "seq bigint, request_ts timestamp_ntz, transfer_id string, user_ref string, "
        "bank_id string, receiver_account string, amount_minor bigint, currency string",
    )
    found = {r.seq: r.violations for r in transfers.with_violations(df).collect()}
    for i, (values, want) in enumerate(cases):
        assert found[i] == want, values
    assert {r.user_ref for r in transfers.valid_transfers(df).collect()} == {"mira"}
    total = transfers.valid_transfers(df).count() + transfers.quarantined_transfers(df).count()
    assert total == len(cases)


def test_transfer_json(spark):
    body = {"user_ref": "mira", "bank_id": "BANK-A", "receiver_account": "ACC-1", "amount_minor": 5}
    raw = spark.createDataFrame(
        [(1, NOW, json.dumps(body)), (2, NOW, json.dumps({**body, "note": "x"}))],
        "seq bigint, request_ts timestamp_ntz, body string",
    )
    parsed = transfers.with_violations(transfers.parse_transfer_json(raw)).orderBy("seq").collect()
    assert parsed[0].violations == [] and parsed[0].currency == "INR"
    assert len(parsed[0].transfer_id) == 36
    assert parsed[1].violations == ["unknown_field"]
    assert parsed[0].transfer_id != parsed[1].transfer_id


@pytest.mark.parametrize(
    "text, minor, why",
    [
        ("8125.50", 812_550, None),
        ("614", 61_400, None),
        (" 0.01 ", 1, None),
        ("1e3", 100_000, None),
        ("77.125", None, "amount_precision"),
        ("100.0000000000000000001", None, "amount_precision"),
        ("100.00000000000000000000", 10_000, None),
        ("NaN", None, "amount_invalid"),
        ("Infinity", None, "amount_invalid"),
        ("ten", None, "amount_invalid"),
        (None, None, "amount_invalid"),
        ("-5.5", -550, None),
    ],
)
def test_minor_units(spark, text, minor, why):
    df = spark.createDataFrame([(text,)], "amount string")
    row = transfers.from_major_units(df).first()
    assert (row.amount_minor, row.amount_reject) == (minor, why)


def test_major_units(spark):
    df = spark.createDataFrame([(12345,)], "m bigint")
    assert str(df.select(money.to_major_units(F.col("m"))).first()[0]) == "123.45"
