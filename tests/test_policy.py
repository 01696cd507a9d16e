from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskweave.functions.policy import (
    CUSTOMER_COPY,
    PolicyConfig,
    PolicyVersions,
    customer_message,
    decision,
)

LARGE = 10**9
# status, score, amount, confidence, banks -> decision under the defaults
TABLE = [
    ("found", 49, 1, 0.9, 1, "allow"),
    ("found", 50, 1, 0.9, 1, "step_up"),
    ("found", 84, 1, 0.9, 1, "step_up"),
    ("found", 85, 1, 0.9, 1, "block"),
    ("found", 86, 1, None, 1, "block"),
    ("found", 99, 1, 0.01, 1, "step_up"),
    ("found", 99, 1, 0.5, 1, "block"),
    ("found", 0, 10_000_000, 0.9, 1, "allow"),
    ("found", 0, 10_000_001, 0.9, 1, "step_up"),
    ("not_found", None, 10_000_000, None, 0, "allow"),
    ("not_found", None, LARGE, None, 0, "step_up"),
    ("unavailable", None, 1, None, 0, "step_up"),
    ("unavailable", 99, 1, 0.9, 3, "step_up"),
]
SCHEMA = "status string, score int, amount bigint, confidence double, banks int, want string"


def decide(spark, rows, policy, strict=False):
    df = spark.createDataFrame(rows, SCHEMA)
    c = F.col
    return df.withColumn(
        "got",
        decision(
            c("status"), c("score"), c("amount"), c("confidence"), c("banks"),
            policy.as_struct(), strict,
        ),
    ).collect()


def test_decision_table(spark):
    for r in decide(spark, TABLE, PolicyConfig(), strict=True):
        assert r.got == r.want, r


def test_corroboration(spark):
    rows = [("found", 99, 1, 0.9, 1, "step_up"), ("found", 99, 1, 0.9, 2, "block")]
    for r in decide(spark, rows, PolicyConfig(min_banks_to_block=2)):
        assert r.got == r.want


@pytest.mark.parametrize("status, score", [("found", None), ("timeout", 99), (None, 10), ("FOUND", 99)])
def test_malformed_evidence_never_allows(spark, status, score):
    rows = [(status, score, 1, None, 1, "block")]
    assert decide(spark, rows, PolicyConfig(on_bus_unavailable="block"))[0].got == "block"
    assert decide(spark, rows, PolicyConfig())[0].got == "step_up"
    with pytest.raises(PySparkException):
        decide(spark, rows, PolicyConfig(), strict=True)


@pytest.mark.parametrize(
    "settings",
    [
        {"step_up_at": 90, "block_at": 50},
        {"on_bus_unavailable": "allow"},
        {"on_bus_unavailable": "maybe"},
        {"block_at": 101},
        {"step_up_at": -1},
        {"min_confidence_to_block": 1.5},
        {"min_banks_to_block": 0},
        {"step_up_above_amount_minor": -1},
    ],
)
def test_bad_policies_are_refused(settings):
    with pytest.raises(ValueError):
        PolicyConfig(**settings)


def test_versions(spark):
    table = spark.createDataFrame(
        [(datetime(2024, 1, 1), 10, 20), (datetime(2024, 2, 1), 30, 40)],
        "valid_from timestamp_ntz, step_up_at int, block_at int",
    )
    versions = PolicyVersions.from_table(table)
    at = spark.createDataFrame(
        [(datetime(2023, 1, 1), 20), (datetime(2024, 1, 31, 23, 59, 59), 20), (datetime(2024, 2, 1), 40)],
        "t timestamp_ntz, want int",
    )
    for r in at.withColumn("p", versions.at(F.col("t"))).collect():
        assert r.p.block_at == r.want
    with pytest.raises(ValueError):
        PolicyVersions.from_table(table.withColumn("extra", F.lit(1)))


def test_customer_copy_names_no_evidence(spark):
    df = spark.createDataFrame([(d,) for d in CUSTOMER_COPY], "d string")
    for r in df.select("d", customer_message(F.col("d")).alias("m")).collect():
        assert r.m == CUSTOMER_COPY[r.d]
        assert not any(ch.isdigit() for ch in r.m) and "BANK" not in r.m
