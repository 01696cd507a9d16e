"""Ranking metrics of a scored table, exact at any size.

Rows are first counted per distinct score. Cumulative counts over the scores then come from two
levels: score segments (a bounded number, scanned in one small window) and the scores inside a
segment (one window per segment), so no task sees all scores.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FPR = 0.05
TARGET_RECALL = 0.5
_QUANTILES = 64
_SLOTS = 1_024
METRICS = ("auc", "pr_auc", "recall_at_fpr_0_05", "fpr_at_recall_0_50")


def _cuts(df: DataFrame, score: str) -> list[float]:
    """Inner quantiles of the score. They only balance the segments; any cuts give exact results."""
    steps = [i / _QUANTILES for i in range(1, _QUANTILES)]
    found = df.agg(
        F.percentile_approx(score, steps, 1_000).alias("q"),
        F.min(score).alias("lo"),
        F.max(score).alias("hi"),
    ).first()
    if found["q"] is None:
        return [0.0, 0.0]
    return sorted({float(v) for v in [found["lo"], *found["q"], found["hi"]]})


def _pick(x: Column, cuts: list[float], leaf) -> Column:
    """Balanced comparison tree: the leaf of the interval `x` lies in."""
    def node(first: int, last: int) -> Column:
        if first == last:
            return leaf(first)
        middle = (first + last + 1) // 2
        return F.when(x < F.lit(cuts[middle]), node(first, middle - 1)).otherwise(node(middle, last))
    return node(0, max(0, len(cuts) - 2))


def _segment(score: Column, cuts: list[float]) -> Column:
    """Segment number, increasing with the score."""
    def slot(i: int) -> Column:
        low, high = cuts[i], cuts[min(i + 1, len(cuts) - 1)]
        if high <= low:
            return F.lit(i * _SLOTS)
        share = F.floor((score - F.lit(low)) / F.lit(high - low) * _SLOTS).cast("int")
        return F.lit(i * _SLOTS) + F.greatest(F.least(share, F.lit(_SLOTS - 1)), F.lit(0))
    return _pick(score, cuts, slot)


def ranked_scores(
    df: DataFrame, by: list[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """One row per distinct score of each group: positives `p` and negatives `n` at the score,
    `tp` and `fp` at or above it, and the group totals `all_p` and `all_n`."""
    cuts = _cuts(df, score)
    positive = (F.col(label) == 1).cast("bigint")
    groups = (
        df.groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("n"))
        .withColumn("segment", _segment(F.col("score"), cuts))
    )
    above = Window.partitionBy(*by).orderBy(F.col("segment").desc())
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    # At most _QUANTILES * _SLOTS rows per group reach this window.
    segments = (
        groups.groupBy(*by, "segment")
        .agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
        .select(
            *by,
            "segment",
            F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("tp_above"),
            F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("fp_above"),
            F.sum("sp").over(every).alias("all_p"),
            F.sum("sn").over(every).alias("all_n"),
        )
    )
    inside = (
        Window.partitionBy(*by, "segment")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return groups.join(segments, [*by, "segment"]).select(
        *by,
        "score",
        "p",
        "n",
        (F.col("tp_above") + F.sum("p").over(inside)).alias("tp"),
        (F.col("fp_above") + F.sum("n").over(inside)).alias("fp"),
        "all_p",
        "all_n",
    )


def ranking_metrics(
    df: DataFrame, by: list[str] | None = None, score: str = "score", label: str = "label"
) -> DataFrame:
    """ROC AUC, average precision, best recall at FPR <= 0.05 and FPR where recall reaches 0.5,
    with `positives` and `rows`, per group. A group of one class has NaN metrics."""
    by = by or []
    p, n, tp, fp = (F.col(c).cast("double") for c in ("p", "n", "tp", "fp"))
    all_p, all_n = F.col("all_p").cast("double"), F.col("all_n").cast("double")
    # Division by zero only happens in one-class groups, whose metrics are replaced below.
    recall, fpr = F.try_divide(tp, all_p), F.try_divide(fp, all_n)
    pairs = n * (tp - p + p / 2)
    ranked = ranked_scores(df, by, score, label)
    measured = ranked.groupBy(*by).agg(
        F.sum(F.try_divide(pairs, all_p * all_n)).alias("auc"),
        F.sum(F.try_divide(p, all_p) * tp / (tp + fp)).alias("pr_auc"),
        F.coalesce(F.max(F.when(fpr <= MAX_FPR, recall)), F.lit(0.0)).alias("recall_at_fpr_0_05"),
        F.coalesce(F.min(F.when(recall >= TARGET_RECALL, fpr)), F.lit(1.0)).alias(
            "fpr_at_recall_0_50"
        ),
        F.sum("p").alias("positives"),
        F.sum(F.col("p") + F.col("n")).alias("rows"),
    )
    one_class = (F.col("positives") == 0) | (F.col("positives") == F.col("rows"))
    return measured.withColumns(
        {m: F.when(one_class, F.lit(float("nan"))).otherwise(F.col(m)) for m in METRICS}
    )


def mean_ignoring_nan(column: str) -> Column:
    """Average of the numbers; NaN when there is none."""
    return F.coalesce(F.avg(F.when(~F.isnan(column), F.col(column))), F.lit(float("nan")))
