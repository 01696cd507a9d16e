from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskweave.functions.accounts import key_pads
from riskweave.operators import signals, trust
from riskweave.operators.skew import join_dimension

T = [datetime(2024, 1, d) for d in range(1, 20)]
KEYS = {k: k.encode() * 8 for k in ("key-a", "key-b", "key-c", "evil-k")}


def events(spark):
    rows = [
        (1, "BANK-B", "register", "key-b", T[0]),
        (2, "BANK-B", "register", "key-b", T[1]),
        (3, "BANK-B", "register", "evil-k", T[2]),
        (4, "BANK-A", "register", "key-a", T[0]),
        (5, "BANK-A", "revoke", None, T[4]),
        (6, "BANK-A", "register", "key-c", T[6]),
        (7, "BANK-Z", "revoke", None, T[0]),
    ]
    return spark.createDataFrame(
        rows, "seq int, bank_id string, action string, key_id string, event_ts timestamp_ntz"
    )


def test_registration_outcomes(spark):
    got = {r.seq: r.outcome for r in trust.registration_outcomes(events(spark)).collect()}
    assert got == {
        1: "registered", 2: "already_registered", 3: "refused", 4: "registered",
        5: "revoked", 6: "registered", 7: "revoked",
    }


def test_intervals(spark):
    rows = trust.trust_intervals(events(spark)).collect()
    assert {(r.bank_id, r.key_id, r.valid_from, r.valid_to) for r in rows} == {
        ("BANK-B", "key-b", T[0], None),
        ("BANK-A", "key-a", T[0], T[4]),
        ("BANK-A", "key-c", T[6], None),
    }


def publishers(spark):
    ring = spark.createDataFrame(
        [(k, *key_pads(v)) for k, v in KEYS.items()],
        "key_id string, inner_pad binary, outer_pad binary",
    )
    return trust.trust_intervals(events(spark)).join(ring, "key_id")


def log(spark, rows):
    full = [
        (i, at, "a" * 64, bank, 92, 0.9, ["mule_account"], "v1", 24, at)
        for i, (bank, at) in enumerate(rows)
    ]
    return spark.createDataFrame(full, signals.SIGNAL_SCHEMA)


def signed(spark, df, key):
    inner, outer = (F.lit(p) for p in key_pads(KEYS[key]))
    return df.withColumn("tag", trust.payload_tag(inner, outer))


def integrity(spark, df):
    rows = trust.verify_payloads(df, publishers(spark)).orderBy("seq").collect()
    return [r.integrity for r in rows]


def test_strangers_revoked_and_rotated(spark):
    rows = [("BANK-X", T[3]), ("BANK-B", T[3])]
    got = integrity(spark, signed(spark, log(spark, rows), "key-b"))
    assert got == ["unknown_publisher", "trusted"]
    moments = [("BANK-A", t) for t in (T[3], T[4], T[5], T[6], T[7])]
    assert integrity(spark, signed(spark, log(spark, moments), "key-a")) == [
        "trusted", "unknown_publisher", "unknown_publisher", "signature_invalid", "signature_invalid",
    ]
    assert integrity(spark, signed(spark, log(spark, moments[3:]), "key-c")) == ["trusted"] * 2


@pytest.mark.parametrize(
    "column, value",
    [
        ("risk_id", f"'{'b' * 64}'"),
        ("risk_score", "0"),
        ("confidence", "0.9000001D"),
        ("reason_codes", "array('confirmed_fraud')"),
        ("model_version", "'v2'"),
        ("source_bank_id", "'BANK-A'"),
        ("ttl_hours", "168"),
        ("timestamp", "timestamp + interval '0.000001' second"),
        ("tag", f"'{'0' * 64}'"),
        ("tag", "'garbage'"),
        ("tag", "cast(null as string)"),
    ],
)
def test_any_change_is_detected(spark, column, value):
    good = signed(spark, log(spark, [("BANK-B", T[1])]), "key-b")
    assert integrity(spark, good) == ["trusted"]
    assert integrity(spark, good.withColumn(column, F.expr(value))) == ["signature_invalid"]


def test_wrong_key(spark):
    assert integrity(spark, signed(spark, log(spark, [("BANK-B", T[1])]), "evil-k")) == ["signature_invalid"]


def test_large_dimension_is_salted_with_equal_result(spark):
    facts = spark.range(200).select(F.col("id").alias("seq"), F.lit("BANK-B").alias("bank"))
    dim = spark.createDataFrame([("BANK-B", 1), ("BANK-C", 2)], "b string, v int")
    def run(limit):
        got = join_dimension(facts, dim, [], ("bank", "b"), "left", ["seq"], max_rows=limit)
        return sorted(tuple(r) for r in got.select("seq", "v").collect())
    assert run(100) == run(1)
