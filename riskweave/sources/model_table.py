"""Model weights as a Parquet table: one row per parameter, partitioned by version."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.scoring import Network


def save_model(weights: DataFrame, version: str, path: str, meta: dict | None = None) -> None:
    """Append a version. `weights` has `layer, pos, value`; `meta` travels with every row."""
    described = weights.select("layer", "pos", "value").withColumns(
        {"meta": F.lit(json.dumps(meta or {}, sort_keys=True)), "version": F.lit(version)}
    )
    # A model is small: its size does not grow with the training rows.
    described.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_weights(spark: SparkSession, version: str, path: str) -> DataFrame:
    # The version is text, whatever it looks like.
    schema = "layer string, pos int, value double, meta string, version string"
    return spark.read.schema(schema).parquet(path).filter(F.col("version") == version)


def load_model(spark: SparkSession, version: str, path: str) -> tuple[Network, dict]:
    rows = load_weights(spark, version, path).collect()
    if not rows:
        raise ValueError(f"no model version {version!r}")
    net = Network.from_entries({(r["layer"], r["pos"]): r["value"] for r in rows})
    return net, json.loads(rows[0]["meta"])
