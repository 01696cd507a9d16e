"""Keeping Catalyst from evaluating an expensive column twice."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """`df`, counted in passing under an observation named `name-...`.

    A filter that follows is not pushed below an observation. Without one, a filter on a computed
    column (a keyed hash, a digest) moves below the projection and the column is computed once for
    the filter and once for the output.
    """
    return df.observe(f"{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
