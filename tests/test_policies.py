"""The version in force among very many, and the union of very many outages."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.functions.policy import PolicyConfig, PolicyVersions
from riskweave.operators import lookup
from riskweave.operators.policies import PolicyTable, policies_of

T0 = datetime(2024, 1, 1)


def versions(spark, starts):
    rows = [(T0 + timedelta(seconds=s), 50 + i % 50) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, "valid_from timestamp_ntz, block_at int")


@pytest.mark.parametrize("rows_per_task", [40, 10**6])
def test_fifty_thousand_versions(spark, rows_per_task):
    rng = random.Random(6)
    # Half of the versions fall into two hours, and there are days without one.
    starts = sorted({rng.randrange(7200) * 0.25 + 90_000 for _ in range(40_000)} | {rng.randrange(10**7) * 1.0 for _ in range(46_000)})
    assert len(starts) > 50_000
    asked = [rng.choice(starts) + rng.choice([-0.000001, 0, 0.000001, 86_400]) for _ in range(300)]
    asked += [-5.0, starts[0], starts[-1] + 10**6, None]
    rows = [(i, None if t is None else T0 + timedelta(seconds=t), "x") for i, t in enumerate(asked)]
    requests = spark.createDataFrame(rows, "id int, request_ts timestamp_ntz, policy string")
    table = PolicyTable.of(versions(spark, starts))
    got = {r.id: r.policy for r in table.apply(requests, rows_per_task=rows_per_task).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        place = 0 if t is None else max(bisect.bisect_right(starts, t) - 1, 0)
        assert got[i].block_at == 50 + place % 50 and got[i].step_up_at == 50, t


def test_few_and_many_versions_decide_alike(spark):
    table = versions(spark, [0, 10, 20])
    assert isinstance(policies_of(table), PolicyVersions)
    requests = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in (-1, 0, 9, 10, 25)], "request_ts timestamp_ntz")
    literal = requests.withColumn("policy", policies_of(table).at(F.col("request_ts"))).orderBy("request_ts").collect()
    assert PolicyTable.of(table).apply(requests).orderBy("request_ts").collect() == literal
    assert isinstance(policies_of(versions(spark, range(100))), PolicyTable)


@pytest.mark.parametrize(
    "column, value",
    [("block_at", 101), ("block_at", 10), ("min_banks_to_block", 0), ("on_bus_unavailable", "allow"), ("min_confidence_to_block", float("nan")), ("other", 1)],
)
def test_bad_versions_are_refused(spark, column, value):
    table = versions(spark, [0]).withColumn(column, F.lit(value))
    with pytest.raises(ValueError):
        PolicyTable.of(table)


def test_no_versions_or_two_at_once(spark):
    with pytest.raises(ValueError, match="at least one"):
        PolicyTable.of(versions(spark, []))
    with pytest.raises(ValueError, match="same instant"):
        PolicyTable.of(versions(spark, [5, 5]))
    assert PolicyTable.of(versions(spark, [5]).withColumn("min_banks_to_block", F.lit(None).cast("int"))).frame.first().policy.min_banks_to_block == PolicyConfig().min_banks_to_block


def test_many_overlapping_outages_are_one(spark):
    outages = spark.range(100_000).select(
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 100)).alias("start_ts"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 100 + 5)).alias("end_ts"),
    )
    cut = outages.select(F.lit(0).alias("__slot"), F.unix_micros(F.col("start_ts").cast("timestamp")).alias("f"), F.unix_micros(F.col("end_ts").cast("timestamp")).alias("t"))
    assert lookup._unions(cut).count() == 1
    pieces = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (1, 9, 10), (2, 3, 4)], "__slot int, f long, t long")
    assert sorted(tuple(r) for r in lookup._unions(pieces).select("__slot", "f", "t").collect()) == [(1, 0, 7), (1, 9, 12), (2, 3, 4)]
    asked = [(-1, False), (0, True), (500, True), (1004, True), (1005, False)]
    risk = spark.createDataFrame(
        [(str(i), T0 + timedelta(seconds=s), 50, ["B"]) for i, (s, _) in enumerate(asked)],
        "transfer_id string, request_ts timestamp_ntz, risk_score int, contributing_banks array<string>",
    )
    got = {r.transfer_id: r.lookup_status for r in lookup.with_lookup_status(risk, outages).collect()}
    assert got == {str(i): "unavailable" if down else "found" for i, (_, down) in enumerate(asked)}
