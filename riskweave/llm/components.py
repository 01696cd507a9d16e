"""Connected components of a stored edge table by alternating large-star and small-star rounds.

Each round hangs every node's neighbours onto their smallest member, first the larger ones, then the
smaller ones; the graph ends as one star per component around its smallest node. Nothing is collected
but a count and a checksum a round. Hubs are split as `join_by_group` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import join_by_group, stored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "star")
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    joined = join_by_group(both, least, "a", "n", both.count())
    return joined.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger node a to the smaller b."""
    edges = stored(edges.where("a != b").distinct(), "star")
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    joined = join_by_group(edges, least, "a", "n", edges.count())
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of `edges` (a, b: long) with the smallest node it is linked to;
    the smallest nodes themselves are not listed."""
    edges = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    # Every edge as a decimal: the checksum can't overflow.
    checksum = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = edges.agg(*checksum).first()
    while before[0]:
        edges = stored(small_star(large_star(edges)).distinct(), "edges")
        after = edges.agg(*checksum).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
