"""Does sharing a model beat training alone? Local baselines against federated averaging."""

import json
import math
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import metrics, scoring, shards, training
from riskweave.operators.training import TrainConfig
from riskweave.sources import fraud_csv, model_table
from riskweave.sources.shared import stored

GLOBAL = "global"


@dataclass(frozen=True)
class Experiment:
    """measured: one row per model (`model` is a bank or "global") on the common holdout.
    report: a plain dictionary, ready for JSON."""

    measured: DataFrame
    report: dict
    network: scoring.Network
    baselines: dict[str, scoring.Network]


def split(
    rows: DataFrame, config: TrainConfig, partition: str, time: str | None
) -> tuple[DataFrame, tuple[str, ...], str]:
    """Add `bank_id` and `is_holdout`; also the bank names and the partitioning that was used.

    bank-identity: rows have a `bank_id`, each bank gives a random share. temporal: the end of the
    time range is held out and the rest cut into periods. dirichlet: label-skewed banks. auto picks
    the first of these that the rows allow.
    """
    if partition == "auto":
        partition = "bank-identity" if "bank_id" in rows.columns else "temporal" if time else "dirichlet"
    if partition == "bank-identity":
        # Known before the holdout: a bank with nothing left to train on is an error, as elsewhere.
        banks = tuple(shards.bank_sizes(rows))
        return shards.pooled_holdout(rows, config.holdout_frac, config.seed), banks, partition
    if partition == "temporal":
        if time is None:
            raise ValueError("temporal shards need a time column")
        order = [time, "id"]
        held = shards.holdout_split(rows, config.holdout_frac, order)
        kept = shards.contiguous_shards(held.filter(~F.col("is_holdout")), config.num_banks, order)
    elif partition == "dirichlet":
        if time is None:
            held = shards.random_holdout(rows, config.holdout_frac, config.seed)
        else:
            held = shards.holdout_split(rows, config.holdout_frac, [time, "id"])
        shares = shards.label_proportions(config.num_banks, config.dirichlet_alpha, config.seed)
        kept = shards.label_skew_shards(held.filter(~F.col("is_holdout")), shares, config.seed)
    else:
        raise ValueError(f"unknown partition {partition!r}")
    named = shards.with_bank_names(kept).drop("shard")
    rest = held.filter("is_holdout").withColumn("bank_id", F.lit(None).cast("string"))
    return named.unionByName(rest), shards.bank_names(config.num_banks), partition


def run_experiment(
    rows: DataFrame,
    features: int,
    config: TrainConfig | None = None,
    partition: str = "auto",
    time: str | None = None,
    dataset: str = "rows",
    model_version: str = "v1",
) -> Experiment:
    """Train and evaluate on `rows` (`id, label, features`, maybe `bank_id` and a `time` of any type that has an
    order)."""
    config = config or TrainConfig()
    marked, banks, used = split(rows, config, partition, time)
    train = marked.filter(~F.col("is_holdout"))
    holdout = marked.filter("is_holdout").select("features", "label")
    sizes = shards.bank_sizes(train, banks)
    # Written once: every round reads the blocks again, and a lost executor must not repeat the packing.
    blocks = training.pack_blocks(train, sizes, features, config)
    blocks = replace(blocks, frame=stored(blocks.frame, "blocks"))
    holdout = stored(holdout, "holdout")
    baselines = training.local_baselines(blocks, config)
    federated = training.federated_rounds(blocks, config)
    measured = evaluate(holdout, {**baselines, GLOBAL: federated.network})
    found = {r["model"]: r.asDict() for r in measured.collect()}  # one row per model
    report = {
        "run": {
            "data": dataset,
            "model_version": model_version,
            "banks_by": used,
            "inputs": features,
            "settings": asdict(config),
            "rounds": federated.rounds_log,
            "leaves_a_bank": ["parameters", "row counts"],
        },
        "models": [_model_row(name, row, sizes.get(name)) for name, row in sorted(found.items())],
        "sharing": _sharing(found, list(sizes)),
    }
    frame = rows.sparkSession.createDataFrame(
        [(m, *[float(r[k]) for k in metrics.METRICS], r["positives"], r["rows"]) for m, r in sorted(found.items())],
        "model string, " + ", ".join(f"{k} double" for k in metrics.METRICS)
        + ", positives bigint, rows bigint",
    )
    return Experiment(frame, report, federated.network, baselines)


def evaluate(holdout: DataFrame, networks: dict[str, scoring.Network]) -> DataFrame:
    """Metrics of several networks (`model`) on the same rows.

    Each network is a branch of its own: side by side in one projection they would exceed what the
    JVM compiles.
    """
    scored = [
        scoring.score_rows(holdout, net, into="score").select(
            F.lit(name).alias("model"), "label", "score"
        )
        for name, net in networks.items()
    ]
    return metrics.ranking_metrics(reduce(DataFrame.unionAll, scored), ["model"])


def _mean(values: list[float]) -> float:
    known = [v for v in values if not math.isnan(v)]
    return sum(known) / len(known) if known else math.nan


def _model_row(name: str, measured: dict, size: tuple[int, int] | None) -> dict:
    """A model with what it was fitted on (all banks, for the shared one) and how it did on the holdout."""
    fitted = {"fitted_rows": size[0], "fitted_positives": size[1]} if size else {}
    scores = {k: measured[k] for k in metrics.METRICS}
    return {"model": name, **fitted, "tested_rows": measured["rows"], "tested_positives": measured["positives"], **scores}


def _sharing(found: dict[str, dict], banks: list[str]) -> dict:
    """Per metric, the mean of the banks alone, the shared model, and whether sharing raised it."""
    out = {}
    for k in metrics.METRICS:
        alone, shared = _mean([found[b][k] for b in banks]), found[GLOBAL][k]
        out[k] = {"alone": alone, "shared": shared, "raised": shared > alone}
    return out


def train_from_csv(
    spark: SparkSession,
    dataset: str,
    path: str,
    model_path: str,
    report_path: str | None = None,
    model_version: str = "v1",
    config: TrainConfig | None = None,
    partition: str = "auto",
    max_rows: int | None = None,
    schema: str | None = None,
) -> Experiment:
    """From a CSV file to a saved model: read and cap the rows, split them into banks, train, measure, and
    append the shared model to the table at `model_path` and the report to `report_path`."""
    config = config or TrainConfig()
    loaded = fraud_csv.load_dataset(spark, dataset, path, schema, max_rows, config.seed)
    rows = loaded.frame.withColumnRenamed("row_id", "id")
    time = "event_time" if loaded.has_time else None
    inputs = len(loaded.feature_names)
    done = run_experiment(rows, inputs, config, partition, time, loaded.name, model_version)
    about = {
        "dataset": loaded.name,
        "n_features": inputs,
        "hidden": config.hidden,
        "feature_names": list(loaded.feature_names),
    }
    model_table.save_model(done.network.table(spark), model_version, model_path, about)
    if report_path is not None:
        write_report(spark, done.report, report_path)
    return done


def nan_to_null(value):
    """A copy in which NaN, which JSON has no word for, is None."""
    if isinstance(value, dict):
        return {k: nan_to_null(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [nan_to_null(v) for v in value]
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """Write the report (a single small record) as JSON."""
    text = json.dumps(nan_to_null(report))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
