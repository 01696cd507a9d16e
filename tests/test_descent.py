"""Full-batch descent against the same arithmetic in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import descent, training
from riskweave.operators.scoring import Network
from riskweave.operators.skew import find_hot_keys

SCHEMA = "id long, bank_id string, label int, features array<double>"


def make(banks, seed=1, features=3):
    rng = np.random.default_rng(seed)
    rows = []
    for bank, n in banks.items():
        x = rng.normal(size=(n, features)) * 3
        y = (x[:, 0] + rng.normal(size=n) > 1).astype(int)
        rows += [(len(rows) + i, bank, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return rows


def by_bank(rows):
    out = {}
    for _, bank, y, x in rows:
        out.setdefault(bank, []).append((y, x))
    return {
        bank: (np.array([x for _, x in part]), np.array([float(y) for y, _ in part])) for bank, part in out.items()
    }


def weight(y):
    return max(len(y) - y.sum(), 1) / max(y.sum(), 1)


def moved(net, x, y, rate):
    g = training._gradient(net, x, y, weight(y))
    return Network(net.w1 - rate * g.w1, net.b1 - rate * g.b1, net.w2 - rate * g.w2, net.b2 - rate * g.b2)


@pytest.mark.parametrize("hidden", [1, 7])
def test_gradients_equal_numpy(spark, hidden):
    rows = make({"A": 40, "B": 9, "C": 1})
    net = Network.initial(3, hidden, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    found = descent.gradients(df, descent.bank_table(df, net), descent.shape_of(net)).collect()
    assert len(found) == 3
    for r in found:
        x, y = by_bank(rows)[r.bank_id]
        assert r.gradient == pytest.approx(descent.flat(training._gradient(net, x, y, weight(y))), abs=1e-12)


def test_rounds_equal_numpy(spark):
    rows, net = make({"A": 60, "B": 20}), Network.initial(3, 4, 2)
    done = training.full_batch_rounds(spark.createDataFrame(rows, SCHEMA), net, rounds=2, steps=2, rate=0.1)
    for _ in range(2):
        total, parts = 0, []
        for x, y in by_bank(rows).values():
            local = net
            for _ in range(2):
                local = moved(local, x, y, 0.1)
            parts.append((len(y), descent.flat(local)))
            total += len(y)
        mean = [sum(n * p[k] for n, p in parts) / total for k in range(len(parts[0][1]))]
        net = descent.network_of(mean, descent.shape_of(net))
    assert descent.flat(done.network) == pytest.approx(descent.flat(net), abs=1e-12)
    assert done.rounds_log == [{"round": 1, "clients": 2}, {"round": 2, "clients": 2}]


def test_a_heavy_bank_is_split_and_odd_rows_count(spark, monkeypatch):
    rows = make({"A": 300, "B": 5})
    odd = [(900, "B", None, [math.nan, None, 1.0]), (901, "B", 1, None), (902, "B", 1, []), (903, None, 1, [1.0] * 3)]
    clean = [(900, "B", 0, [0.0, 0.0, 1.0]), (901, "B", 1, [0.0] * 3), (902, "B", 1, [0.0] * 3)]
    df, net = spark.createDataFrame(rows + odd, SCHEMA), Network.initial(3, 3, 8)
    shape = descent.shape_of(net)
    banks = descent.bank_table(df, net)
    # As if the banks were too many to broadcast.
    monkeypatch.setattr(descent, "is_small", lambda _: False)
    split = descent.gradients(df, banks, shape, find_hot_keys(df, ["bank_id"], rows_per_task=50))
    for r in split.collect():
        x, y = by_bank(rows + clean)[r.bank_id]
        expected = training._gradient(net, x, y, weight(y))
        assert r.gradient == pytest.approx(descent.flat(expected), abs=1e-12)


def test_no_rows_and_large_networks(spark):
    net = Network.initial(3, 3, 8)
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        training.full_batch_rounds(empty, net, 1, 1, 0.1)
    assert training.full_batch_baselines(empty, net, 1, 0.1).isEmpty()
    large = Network.initial(100, 100, 1)
    with pytest.raises(ValueError):
        descent.gradients(empty, empty, descent.shape_of(large))


def test_parameters_are_named_by_layer(spark):
    net = Network.initial(2, 3, 1)
    df = spark.createDataFrame(make({"A": 4}, features=2), SCHEMA)
    long = descent.parameters(descent.bank_table(df, net), descent.shape_of(net)).collect()
    assert sorted((r.layer, r.pos, r.value) for r in long) == sorted(net.entries())
    assert {r.n for r in long} == {4}


def test_rows_are_read_once_for_all_steps(spark):
    rows, read = make({"A": 30, "B": 10}), spark.sparkContext.accumulator(0)

    def look(label):
        read.add(1)
        return label

    seen = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.udf(look, "int")("label"))
    training.full_batch_baselines(seen, Network.initial(3, 4, 2), 4, 0.1).collect()
    # Once to count the rows of the banks, once to pack them.
    assert read.value == 2 * len(rows)


def test_blocks_hold_all_rows_of_a_bank(spark, monkeypatch):
    monkeypatch.setattr(descent, "BLOCK_BYTES", 3 * 4 * 8)
    monkeypatch.setattr(descent, "HELD_BYTES", 10 * 4 * 8)
    rows = make({"A": 50, "B": 7}) * 2
    odd = [(900, "C", None, [math.nan, None, 1.0, 5.0]), (901, "C", 1, None), (902, None, 1, [1.0] * 3)]
    df, net = spark.createDataFrame(rows + odd, SCHEMA), Network.initial(3, 2, 4)
    shape, found = descent.shape_of(net), []
    for r in descent.packed(df, shape).collect():
        numbers = np.frombuffer(r.block, "<f8").reshape(4, -1)
        assert numbers.shape[1] == r.rows <= 3
        found += [(r.bank_id, *map(float, row)) for row in numbers.T]
    clean = [(900, "C", 0, [0.0, 0.0, 1.0]), (901, "C", 1, [0.0] * 3)]
    assert sorted(found) == sorted((bank, float(y), *x) for _, bank, y, x in rows + clean)
    for small in (True, False):
        # Few banks are broadcast, many are joined.
        monkeypatch.setattr(descent, "is_small", lambda _, small=small: small)
        hot = find_hot_keys(df, ["bank_id"], rows_per_task=50)
        for r in descent.block_gradients(descent.packed(df, shape), descent.bank_table(df, net), shape, hot).collect():
            x, y = by_bank(rows + clean)[r.bank_id]
            expected = training._gradient(net, x, y, weight(y))
            assert r.gradient == pytest.approx(descent.flat(expected), abs=1e-12)


def test_rounding_and_infinity_are_those_of_columns(spark):
    # The unit's input is 0.1 + 0.2 - 0.3, which is not 0 when added from the left; infinity makes it NaN or clips.
    net = Network(np.array([[0.1], [0.2], [-0.3]]), np.zeros(1), np.array([2.0]), 0.5)
    p = 1 / (1 + math.exp(-0.5))
    high = 1 / (1 + math.exp(-20))
    rows = [(1, "A", 0, [1.0] * 3), (2, "B", 0, [math.inf, 0.0, 0.0]), (3, "C", 0, [math.inf, 0.0, math.inf])]
    df, shape = spark.createDataFrame(rows, SCHEMA), descent.shape_of(net)
    banks = descent.bank_table(df, net)
    found = {r.bank_id: r.gradient for r in descent.block_gradients(descent.packed(df, shape), banks, shape).collect()}
    columns = {r.bank_id: r.gradient for r in descent.gradients(df, banks, shape).collect()}
    assert all(found[bank] == pytest.approx(g, abs=1e-12, nan_ok=True) for bank, g in columns.items())
    assert found["A"] == pytest.approx([2 * p, 2 * p, 2 * p, 2 * p, 0, p], abs=1e-12)
    assert found["B"] == pytest.approx([math.inf, 0, 0, 2 * high, math.inf, high])
    assert found["C"] == pytest.approx([math.inf, 0, math.inf, 2 * high, math.nan, high], nan_ok=True)
