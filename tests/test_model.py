import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import metrics, scoring, shards, training
from riskweave.operators.scoring import Network
from riskweave.operators.training import TrainConfig
from riskweave.plans import experiment
from riskweave.sources import fraud_csv, model_table, shared


# Shards -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [
        (f"{i:05d}", rng.randint(0, 5), 1 if rng.random() < 0.2 else 0, f"BANK-{'ABC'[min(i % 7, 2)]}")
        for i in range(703)
    ]
    return spark.createDataFrame(rows, "id string, t bigint, label int, bank_id string")


@pytest.mark.parametrize("fetch", [10, 10_000])
def test_contiguous_shards_equal_array_split(labelled, fetch):
    rows = shards.contiguous_shards(labelled, 5, ["t", "id"], fetch).orderBy("t", "id").collect()
    want = [i for i, part in enumerate(np.array_split(np.arange(703), 5)) for _ in part]
    assert [r.shard for r in rows] == want


def test_more_shards_than_rows(labelled):
    got = shards.contiguous_shards(labelled.filter("id < '00003'"), 5, ["id"]).orderBy("id").collect()
    assert [r.shard for r in got] == [0, 1, 2]


def test_label_skew_covers_every_row(labelled):
    shares = shards.label_proportions(4, 0.5, 42)
    got = shards.label_skew_shards(labelled, shares, 42, fetch_rows=20)
    assert got.count() == 703 and got.filter("shard is null").count() == 0
    found = {(r.label, r.shard): r["count"] for r in got.groupBy("label", "shard").count().collect()}
    n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    for label, share in shares.items():
        want = shards.counts_from_proportions(n[label], share)
        assert [found.get((label, s), 0) for s in range(4)] == want


def test_counts_from_proportions():
    assert shards.counts_from_proportions(10, [0.5, 0.25, 0.25]) == [5, 3, 2]
    assert sum(shards.counts_from_proportions(997, [0.001, 0.333, 0.666])) == 997
    assert shards.counts_from_proportions(0, [0.5, 0.5]) == [0, 0]


@pytest.mark.parametrize("frac", [0.0, 0.2, 0.999, 1.0])
def test_holdout_by_time(labelled, frac):
    rows = shards.holdout_split(labelled, frac, ["t", "id"], 15).orderBy("t", "id").collect()
    cut = int(703 * (1.0 - frac))
    assert [r.is_holdout for r in rows] == [i >= cut for i in range(703)]


def test_random_and_pooled_holdout(labelled):
    assert shards.random_holdout(labelled, 0.2, 1).filter("is_holdout").count() == 703 - int(703 * 0.8)
    held = shards.pooled_holdout(labelled, 0.001, 3, fetch_rows=20).filter("is_holdout")
    assert {r.bank_id: r["count"] for r in held.groupBy("bank_id").count().collect()} == {
        "BANK-A": 1, "BANK-B": 1, "BANK-C": 1
    }
    sizes = {r.bank_id: r["count"] for r in labelled.groupBy("bank_id").count().collect()}
    held = shards.pooled_holdout(labelled, 0.25, 3, fetch_rows=20).filter("is_holdout")
    got = {r.bank_id: r["count"] for r in held.groupBy("bank_id").count().collect()}
    assert got == {b: max(1, round(n * 0.25)) for b, n in sizes.items()}


def test_cap_keeps_all_positives(labelled, monkeypatch):
    monkeypatch.setattr(shards, "MIN_SAMPLED_NEGATIVES", 50)
    positives = labelled.filter("label = 1").count()
    for limit, negatives in ((300, 300 - positives), (100, 50), (10**6, 703 - positives)):
        got = shards.cap_keeping_positives(labelled, limit, 9)
        assert got.filter("label = 1").count() == positives
        assert got.filter("label = 0").count() == negatives
    assert [r.id for r in shards.first_rows(labelled, 3, ["id"]).orderBy("id").collect()] == [
        "00000", "00001", "00002"
    ]


def test_bank_names_and_empty_banks(spark):
    assert shards.bank_names(7) == ("BANK-A", "BANK-B", "BANK-C", "BANK-D", "BANK-E", "BANK-5", "BANK-6")
    df = spark.createDataFrame([(i, 1) for i in (0, 4, 5, 6)], "shard int, label int")
    named = shards.with_bank_names(df)
    assert {r.shard: r.bank_id for r in named.collect()} == {
        0: "BANK-A", 4: "BANK-E", 5: "BANK-5", 6: "BANK-6"
    }
    with pytest.raises(ValueError):
        shards.bank_sizes(named, shards.bank_names(7))


# Metrics ------------------------------------------------------------------------------------------


def brute(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return [math.nan] * 4
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, recall_ok, fpr_hit, seen = 0.0, 0.0, 1.0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        ap += (tp - seen) / len(pos) * tp / (tp + fp)
        seen = tp
        if fp / len(neg) <= 0.05:
            recall_ok = max(recall_ok, tp / len(pos))
        if tp / len(pos) >= 0.5:
            fpr_hit = min(fpr_hit, fp / len(neg))
    return [auc, ap, recall_ok, fpr_hit]


def test_metrics_equal_brute_force(spark):
    rng = random.Random(2)
    groups = {
        "ties": [(rng.randint(0, 9) / 10, rng.randint(0, 1)) for _ in range(300)],
        # Nearly all scores crowd into a tiny range.
        "crowded": [(0.5 + rng.random() * 1e-9, rng.randint(0, 1)) for _ in range(400)],
        "spread": [(rng.gauss(y, 1.0), y) for y in (rng.randint(0, 1) for _ in range(400))],
        "perfect": [(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)],
        "inverted": [(0.9, 0), (0.1, 1)],
        "constant": [(0.5, 0), (0.5, 1), (0.5, 1)],
        "one class": [(0.3, 1), (0.4, 1)],
    }
    rows = [(g, float(s), y) for g, part in groups.items() for s, y in part]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    found = {r.g: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    for g, part in groups.items():
        got = [found[g][m] for m in metrics.METRICS]
        assert got == pytest.approx(brute(part), abs=1e-12, nan_ok=True), g
        assert found[g].positives == sum(y for _, y in part) and found[g]["rows"] == len(part)
    assert found["perfect"].auc == 1.0
    whole = metrics.ranking_metrics(df).first()
    assert [whole[m] for m in metrics.METRICS] == pytest.approx(brute([r[1:] for r in rows]), abs=1e-12)


def test_mean_ignores_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "v double")
    assert df.agg(metrics.mean_ignoring_nan("v")).first()[0] == 1.5
    assert math.isnan(df.filter("isnan(v)").agg(metrics.mean_ignoring_nan("v")).first()[0])


# Training -----------------------------------------------------------------------------------------


def test_weighted_average(spark):
    rows = [(1, "w1", 0, 1.0), (3, "w1", 0, 0.0), (1, "b2", 0, 2.0), (3, "b2", 0, 2.0)]
    updates = spark.createDataFrame(rows, "n bigint, layer string, pos int, value double")
    got = {r.layer: r.value for r in training.weighted_average(updates).collect()}
    assert got == {"w1": 0.25, "b2": 2.0}
    with pytest.raises(ValueError):
        training._one_network(training.weighted_average(updates.limit(0)))


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = Network.initial(3, 5, 1)
    x, y, weight = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), 3.0

    def loss(entries):
        n = Network.from_entries(entries)
        z = np.maximum(x @ n.w1 + n.b1, 0) @ n.w2 + n.b2
        p = 1 / (1 + np.exp(-z))
        return np.mean(np.where(y == 1, weight, 1) * -(y * np.log(p) + (1 - y) * np.log(1 - p)))

    entries = {(k, i): v for k, i, v in net.entries()}
    gradient = {(k, i): v for k, i, v in training._gradient(net, x, y, weight).entries()}
    for key in entries:
        up, down = ({**entries, key: entries[key] + d} for d in (1e-6, -1e-6))
        assert gradient[key] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) * 30
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, features array<double>")
    for hidden in (16, 300):
        net = Network.initial(4, hidden, 3)
        z = np.clip(np.maximum(x @ net.w1 + net.b1, 0) @ net.w2 + net.b2, -20, 20)
        got = [r.probability for r in scoring.score_rows(df, net).orderBy("i").collect()]
        assert got == pytest.approx(list(1 / (1 + np.exp(-z))), rel=1e-12)


def test_signal_fields_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.0,), (1.0,), (0.98765,)], "probability double")
    got = scoring.signal_fields(df, "v9").collect()
    assert [r.risk_score for r in got] == [12, 14, 0, 100, 99]
    assert [r.confidence for r in got] == [0.875, 0.865, 1.0, 1.0, 0.9876]
    assert got[0].model_version == "v9"


@pytest.fixture(scope="module")
def banks_with_own_fraud(spark):
    """Every bank sees another kind of fraud: one of its features is far out, so a shared model should
    do better."""
    rng = np.random.default_rng(4)
    rows = []
    for b in range(3):
        x = rng.uniform(-1, 1, size=(400, 4))
        y = (x[:, b] > 0.6) & (rng.uniform(size=400) < 0.9)
        x[y, b] += 0.5
        rows += [
            (f"{b}-{i:04d}", f"BANK-{'ABC'[b]}", int(y[i]), [float(v) for v in x[i]], b * 400 + i)
            for i in range(400)
        ]
    schema = "id string, bank_id string, label int, features array<double>, t bigint"
    return spark.createDataFrame(rows, schema)


def test_shared_model_beats_local_ones(spark, banks_with_own_fraud):
    done = experiment.run_experiment(banks_with_own_fraud, 4)
    r = done.report
    assert r["run"]["banks_by"] == "bank-identity" and r["sharing"]["auc"]["raised"]
    models = {m["model"]: m for m in r["models"]}
    assert sum(m.get("fitted_rows", 0) for m in models.values()) == 960 and len(models) == 4
    assert done.measured.count() == 4 and len(r["run"]["rounds"]) == 8
    path = shared.fresh_dir(spark, "report")
    experiment.write_report(spark, {**r, "none": math.nan}, path)
    back = json.loads(spark.read.text(path).first()[0])
    assert back["none"] is None and {m["tested_rows"] for m in back["models"]} == {240}


def test_blocks_are_averaged_by_their_rows(banks_with_own_fraud):
    config = TrainConfig(rounds=2, local_epochs=1, batch_size=32, blocks=3)
    sizes = shards.bank_sizes(banks_with_own_fraud)
    blocks = training.pack_blocks(banks_with_own_fraud, sizes, 4, config)
    assert blocks.count == 9
    packed = blocks.frame.collect()
    assert sum(len(r.y) for r in packed) == 1200
    net = Network.initial(4, config.hidden, config.seed)
    for number in (1, 2):
        parts = []
        for r in packed:
            seed = training.derived_seed(config.seed, r.bank_id, r.block, number)
            x, y = np.array(r.x).reshape(-1, 4), np.array(r.y, dtype=float)
            n, p = sizes[r.bank_id]
            parts.append((len(y), training.fit_block(net, x, y, (n - p) / p, 1, 32, 0.05, seed)))
        total = sum(n for n, _ in parts)
        mean = {}
        for n, part in parts:
            for k, i, v in part.entries():
                mean[(k, i)] = mean.get((k, i), 0.0) + v * n / total
        net = Network.from_entries(mean)
    got = training.federated_rounds(blocks, config).network
    assert [v for *_, v in got.entries()] == pytest.approx([v for *_, v in net.entries()], abs=1e-12)


def test_fitted_rows_are_bounded_by_a_hash(banks_with_own_fraud):
    sizes = shards.bank_sizes(banks_with_own_fraud)
    config = TrainConfig(blocks=2, most_rows=100)
    one, two = (training.pack_blocks(banks_with_own_fraud, sizes, 4, config).frame.collect() for _ in range(2))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 6
    per_bank = {b: sum(len(r.y) for r in one if r.bank_id == b) for b in sizes}
    assert all(50 < n < 160 for n in per_bank.values())
    assert {r.pos_weight for r in one} == {(n - p) / p for n, p in sizes.values()}


def test_banks_over_the_bound_weigh_their_full_size(spark):
    # Every bank is over the bound of fitted rows: 12, 3 and 1 times.
    wanted = {"a": 2400, "b": 600, "c": 201}
    rows = [(f"{b}{i}", b, int(i % 4 == 0), [float(i % 7), 1.0, 0.0, 0.5]) for b, n in wanted.items() for i in range(n)]
    train = spark.createDataFrame(rows, "id string, bank_id string, label int, features array<double>")
    config = TrainConfig(blocks=2, most_rows=200, hidden=2)
    blocks = training.pack_blocks(train, shards.bank_sizes(train), 4, config)
    start = {b: Network.initial(4, 2, i) for i, b in enumerate(sorted(wanted))}
    # Without epochs the banks return what they were sent.
    updates = training.fit_round(blocks, start, config, 0, 1)
    banks = training.weighted_average(updates, ["bank_id"]).select("bank_id", "n").distinct().collect()
    assert {r.bank_id: r.n for r in banks} == wanted
    got = training._one_network(training.weighted_average(updates))
    assert got.w1 == pytest.approx(sum(start[b].w1 * n for b, n in wanted.items()) / sum(wanted.values()))


@pytest.mark.parametrize("hidden", [2, 200])
def test_scores_of_odd_features_are_alike_at_every_size(spark, hidden):
    nan = math.nan
    rows = [([1.0, 1.0, 1.0, 1.0],), ([nan, 1.0, None, 1.0],), ([1.0],), (None,), ([],), ([1.0] * 6,)]
    df = spark.createDataFrame(rows, "features array<double>")
    net = Network(np.tile([[1.0 / hidden], [2.0 / hidden], [4.0 / hidden], [8.0 / hidden]], hidden), np.zeros(hidden), np.ones(hidden), -1.0)
    got = [r.probability for r in scoring.score_rows(df, net).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(1 - z)) for z in (15, 10, 1, 0, 0, 15)])


@pytest.mark.parametrize("partition, time", [("temporal", "t"), ("auto", "t"), ("dirichlet", None)])
def test_other_partitions(banks_with_own_fraud, partition, time):
    config = TrainConfig(num_banks=2, rounds=1, local_epochs=1)
    r = experiment.run_experiment(banks_with_own_fraud.drop("bank_id"), 4, config, partition, time).report
    assert r["run"]["banks_by"] == ("temporal" if time else "dirichlet")
    tested = {m["tested_rows"] for m in r["models"]}
    assert len(tested) == 1 and sum(m.get("fitted_rows", 0) for m in r["models"]) + tested.pop() == 1200


def test_temporal_without_time_is_an_error(banks_with_own_fraud):
    with pytest.raises(ValueError):
        experiment.run_experiment(banks_with_own_fraud.drop("bank_id"), 4, partition="temporal")


def test_model_table(spark):
    path = shared.fresh_dir(spark, "models")
    nets = {v: Network.initial(4, 16, s) for v, s in (("001", 1), ("1", 2))}
    for version, net in nets.items():
        model_table.save_model(net.table(spark), version, path, {"dataset": version})
    for version, net in nets.items():
        loaded, meta = model_table.load_model(spark, version, path)
        assert meta == {"dataset": version}
        assert np.array_equal(loaded.w1, net.w1) and np.array_equal(loaded.w2, net.w2)
    with pytest.raises(ValueError):
        model_table.load_model(spark, "missing", path)


# CSV ----------------------------------------------------------------------------------------------


def write_csv(tmp_path, header, *lines):
    path = tmp_path / "data.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_card_csv(spark, tmp_path):
    path = write_csv(tmp_path, "Time,V1,V2,Amount,Class", "0,1.5,-2,0,0", "7,0.5,3,1.718281828459045,1")
    rows = fraud_csv.load_dataset(spark, " ULB ", path)
    assert rows.feature_names == ("V1", "V2", "log_amount") and rows.has_time
    got = rows.frame.orderBy("row_id").collect()
    assert got[1].features == pytest.approx([0.5, 3.0, 1.0]) and got[1].label == 1
    assert got[1].event_time == 7.0 and got[0].row_id < got[1].row_id


def test_mobile_money_csv(spark, tmp_path):
    path = write_csv(
        tmp_path, "step,type,amount,isFraud,isFlaggedFraud", "1,PAY,NaN,0,1", "2,PAY,,1,0", "3,PAY,Infinity,0,0"
    )
    rows = fraud_csv.load_dataset(spark, "paysim", path)
    assert rows.feature_names == ("step", "amount")
    got = rows.frame.orderBy("row_id").collect()
    assert [r.features for r in got] == [[1, 0], [2, 0], [3, fraud_csv.MAX_FLOAT32]]
    assert [r.label for r in got] == [0, 1, 0]


def test_card_not_present_csv(spark, tmp_path):
    path = write_csv(tmp_path, "TransactionID,isFraud,TransactionDT,kind", "9,1,86400,x")
    rows = fraud_csv.load_dataset(spark, "ieee-cis", path)
    assert rows.feature_names == ("TransactionID", "TransactionDT") and rows.frame.first().event_time == 86400
    schema = "TransactionID bigint, isFraud int, TransactionDT bigint, kind string"
    assert fraud_csv.load_dataset(spark, "ieee", path, schema).frame.first().features == [9, 86400]
    with pytest.raises(ValueError):
        fraud_csv.load_dataset(spark, "other", path)


def test_from_csv_to_a_saved_model(spark, tmp_path):
    rng = random.Random(5)
    lines = []
    for i in range(300):
        v = [round(rng.gauss(0, 1), 3) for _ in range(2)]
        lines.append(f"{i // 4}.5,{v[0]},{v[1]},{rng.randint(0, 99)},{int(v[0] > 0.8)}")
    lines += ["oops", "7.0,x,1,1,0", "8.0,1,1,1,"]
    path = write_csv(tmp_path, "Time,V1,V2,Amount,Class", *lines)
    schema = "Time double, V1 double, V2 double, Amount double, Class int"
    models, report = shared.fresh_dir(spark, "models"), shared.fresh_dir(spark, "report")
    config = TrainConfig(num_banks=2, rounds=1, local_epochs=1, hidden=3)
    done = experiment.train_from_csv(spark, "ulb", path, models, report, "v7", config, schema=schema)
    net, about = model_table.load_model(spark, "v7", models)
    assert np.array_equal(net.w1, done.network.w1)
    assert about["feature_names"] == ["V1", "V2", "log_amount"] and about["hidden"] == 3
    written = json.loads(spark.read.text(report).first()[0])
    assert written["run"]["banks_by"] == "temporal" and written["run"]["model_version"] == "v7"
    loaded = fraud_csv.load_dataset(spark, "ulb", path, schema)
    assert loaded.frame.count() == 300 and loaded.quarantined.count() == 3
    assert {r._corrupt_record for r in loaded.quarantined.collect()} == {"oops", "7.0,x,1,1,0", None}
    capped = fraud_csv.load_dataset(spark, "paysim", write_csv(tmp_path, "step,amount,isFraud", *(f"{i},1,0" for i in range(9))), max_rows=4)
    assert sorted(r.event_time for r in capped.frame.collect()) == [0, 1, 2, 3]


def test_a_bank_with_nothing_left_to_train_on_is_an_error(spark, banks_with_own_fraud):
    one = spark.createDataFrame([("x", "BANK-Z", 1, [0.0] * 4, 1)], banks_with_own_fraud.schema)
    with pytest.raises(ValueError, match="BANK-Z"):
        experiment.run_experiment(banks_with_own_fraud.unionAll(one), 4)
    lost = banks_with_own_fraud.withColumn("bank_id", F.when(F.col("t") > 5, F.col("bank_id")))
    with pytest.raises(ValueError, match="no bank"):
        experiment.run_experiment(lost, 4)
