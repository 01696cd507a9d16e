"""Scoring rows with a one-hidden-layer network, and turning scores into signals."""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.accounts import Pseudonymiser

MAX_LOGIT = 20.0
# Up to this many weights the network is written out as one arithmetic expression, which stays
# below the size the JVM compiles; a larger one is scored in Arrow batches.
MAX_UNROLLED = 512
LAYERS = ("w1", "b1", "w2", "b2")


@dataclass(frozen=True)
class Network:
    """ReLU network: `w1` is features x hidden, `b1` and `w2` are hidden, `b2` is one number."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def initial(cls, features: int, hidden: int, seed: int) -> "Network":
        """He initialisation."""
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0.0, np.sqrt(2.0 / features), (features, hidden)),
            np.zeros(hidden),
            rng.normal(0.0, np.sqrt(2.0 / hidden), hidden),
            0.0,
        )

    @classmethod
    def from_entries(cls, entries: dict[tuple[str, int], float]) -> "Network":
        """From (layer, position) -> value, `w1` row by row."""
        size = {name: sum(1 for layer, _ in entries if layer == name) for name in LAYERS}
        flat = {
            name: np.array([entries[(name, i)] for i in range(size[name])]) for name in LAYERS
        }
        hidden = size["b1"]
        return cls(flat["w1"].reshape(-1, hidden), flat["b1"], flat["w2"], float(flat["b2"][0]))

    def entries(self) -> list[tuple[str, int, float]]:
        flat = (self.w1.ravel(), self.b1, self.w2, [self.b2])
        return [
            (name, i, float(v)) for name, values in zip(LAYERS, flat) for i, v in enumerate(values)
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries(), "layer string, pos int, value double")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _unrolled_logit(x: list[Column], net: Network) -> Column:
    units = []
    for j in range(len(net.b1)):
        inner = _sum([x[i] * float(net.w1[i, j]) for i in range(len(x))]) + float(net.b1[j])
        units.append(F.greatest(inner, F.lit(0.0)) * float(net.w2[j]))
    return _sum(units) + float(net.b2)


def _vectorised_probability(net: Network):
    """Arrow-batched scoring: a network too large for one compiled expression is a matrix product."""

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        x = np.vstack(features.to_numpy()).astype(float)
        z = np.maximum(x @ net.w1 + net.b1, 0.0) @ net.w2 + net.b2
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -MAX_LOGIT, MAX_LOGIT))))

    return score


def score_rows(
    df: DataFrame, net: Network, features: str = "features", into: str = "probability"
) -> DataFrame:
    """Add the probability of fraud. A feature that is NULL, NaN or beyond the end of the array counts
    as 0, whatever the size of the network; so do all of a NULL array."""
    count = net.w1.shape[0]

    def feature(i: Column) -> Column:
        return F.coalesce(F.nanvl(F.get(F.col(features), i), F.lit(0.0)), F.lit(0.0))

    if net.w1.size > MAX_UNROLLED:
        whole = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), feature)
        return df.withColumn(into, _vectorised_probability(net)(whole))
    # Non-null columns let the generated code do without a null check per operation.
    inputs = {f"__x{i}": feature(F.lit(i)) for i in range(count)}
    z = _unrolled_logit([F.col(x) for x in inputs], net)
    clipped = F.greatest(F.least(z, F.lit(MAX_LOGIT)), F.lit(-MAX_LOGIT))
    scored = df.withColumns(inputs).withColumn(into, 1.0 / (1.0 + F.exp(-clipped)))
    return scored.drop(*inputs)


def signal_fields(df: DataFrame, model_version: str) -> DataFrame:
    """Add `risk_score`, `confidence` and `model_version` from `probability`."""
    p = F.col("probability")
    percent = F.bround(p * 100, 0).cast("int")
    return df.withColumns(
        {
            "risk_score": F.greatest(F.least(percent, F.lit(100)), F.lit(0)),
            "confidence": F.bround(F.greatest(p, 1 - p), 4),
            "model_version": F.lit(model_version),
        }
    )


def publishable_signals(
    scored: DataFrame,
    pseudonymiser: Pseudonymiser,
    threshold: int,
    ttl_hours: int,
    reason_code: str,
) -> DataFrame:
    """Signals for rows at or above `threshold`, without the account itself.

    `scored` has `seq, arrival_ts, account, source_bank_id` and the fields of `signal_fields`.
    """
    strong = scored.filter(F.col("risk_score") >= threshold)
    return strong.select(
        "seq",
        "arrival_ts",
        pseudonymiser.risk_id(F.col("account")).alias("risk_id"),
        "source_bank_id",
        "risk_score",
        "confidence",
        F.array(F.lit(reason_code)).alias("reason_codes"),
        "model_version",
        F.lit(ttl_hours).alias("ttl_hours"),
        F.col("arrival_ts").alias("timestamp"),
    )
