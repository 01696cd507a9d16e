"""Quality rules (operator 3) with risk-controlled cutoffs; DataFrame functions only.

Each rule rejects a document whose measure reaches a cutoff. Cutoffs come from labelled documents, one
set per stratum (language):

* A third of the labelled rows tells which cutoffs of a fixed grid are useful: they reject a larger
  share of bad documents (quality 0) than `LIFT` times that of good ones (quality 1).
* The others are the holdout. For a cutoff that rejects k of the n good ones there, the exact binomial
  tail P(Bin(n, a) <= k) is the p-value of "it rejects more than the share a of good documents".
* Cutoffs are tested from the most lenient on, and testing stops at the first that isn't proven (a fixed
  sequence needs no correction within itself); the level is divided by the number of sequences, one for
  each stratum and rule (Bonferroni). The strictest proven and useful cutoff is taken, else none.

With a = RISK / number of rules, all rules of a stratum together reject more than `RISK` of its good
documents with a probability of at most `LEVEL` over all strata. Strata with few labels get no cutoffs
and lose no documents.

Words are maximal runs without ASCII white space. A null text has no words. A null stratum is a stratum
of its own. Labels for one document that differ count as the lower. Repeated rows get a row each. Windows
of eight words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WHITE, fresh_name, remainder, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
RISK, LEVEL, LIFT = 0.03, 0.05, 2.0
#: Of three parts of the labelled rows, the one that only tells what is useful.
LEARNING_PARTS = 3
#: Base rule, fixed by the contract: fewest words, largest percentage of repeated words.
FEWEST_WORDS, MOST_REPEATED = 20, 30


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.translate(text, WHITE, " " * len(WHITE))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")

    def lengths(found: Column) -> Column:
        return F.struct(F.size(found).alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).alias("n_dup"))

    def counted(found: Column) -> Column:
        return F.struct(F.size(found).alias("n_words"), repeated_words(F.transform(found, lambda word: F.xxhash64(word))).alias("n_repeat"))

    of_lines, of_words = fresh_name(docs, "of_lines"), fresh_name(docs, "of_words")
    return (
        docs.withColumn(of_lines, bound(lines, lengths))
        .withColumn(of_words, bound(words, counted))
        .withColumn("n_words", F.col(f"{of_words}.n_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(spaced, " ", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.col(f"{of_lines}.n_lines").cast("long"))
        .withColumn("n_dup_lines", F.col(f"{of_lines}.n_dup").cast("long"))
        .withColumn("n_repeat_words", F.col(f"{of_words}.n_repeat").cast("long"))
        .drop(of_lines, of_words)
    )


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words that occurs again, from the hashes of all words."""

    def windows(h: Column) -> Column:
        starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        return bound(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))), covered)

    def covered(w: Column) -> Column:
        none = F.size(w) == F.size(F.array_distinct(w))
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(none, F.lit(0)).otherwise(bound(placed, union_of_repeats))

    def union_of_repeats(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            other = [F.coalesce(F.get(s, i + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
            return other[0] | other[1]

        starts = F.sort_array(F.transform(F.filter(s, again), lambda x: x["at"]))
        # Windows from left to right: each adds what the ones before don't cover.
        total = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda t, at: F.struct(
                (t["n"] + at + WINDOW - F.greatest(t["end"], at)).alias("n"), (at + WINDOW).alias("end")
            ),
        )
        return total["n"]

    return bound(hashes, windows)


def share_of(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: Measures of the rules, the larger the worse, with their ascending grids of cutoffs.
RULES: dict[str, tuple[Callable[[], Column], list[float]]] = {
    "symbol_share": (lambda: share_of("n_symbols", "word_chars"), [i / 100 for i in range(1, 51)]),
    "dup_line_share": (lambda: share_of("n_dup_lines", "n_lines"), [i / 50 for i in range(1, 51)]),
    "repeat_share": (lambda: share_of("n_repeat_words", "n_words"), [i / 50 for i in range(1, 51)]),
    "word_length": (lambda: share_of("word_chars", "n_words"), [6 + i / 2 for i in range(50)]),
}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly: the sum of its terms. 1 where k is over the mean, which proves nothing."""
    from math import log

    ratio = p / (1 - p)
    terms = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct((n * F.lit(log(1 - p))).alias("log_term"), F.lit(0.0).alias("sum")),
        lambda t, i: F.struct(
            (t["log_term"] + F.log((n - i).cast("double") / (i + 1) * ratio)).alias("log_term"),
            (t["sum"] + F.exp(t["log_term"])).alias("sum"),
        ),
    )
    return F.when((n == 0) | (k > n * p), F.lit(1.0)).otherwise(F.least(terms["sum"], F.lit(1.0)))


def cutoffs(labelled: DataFrame, stratum: str, good: str, holdout: str) -> DataFrame:
    """(stratum, rule, cutoff) of measured labelled rows; only proven cutoffs. Stratum values are strings
    without nulls."""
    level_of = [
        F.struct(
            F.lit(name).alias("rule"),
            # How many cutoffs of the grid the measure reaches.
            sum((F.when(measure() >= c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("reached"),
        )
        for name, (measure, cuts) in RULES.items()
    ]
    each = labelled.select(stratum, good, holdout, F.explode(F.array(*level_of)).alias("r")).select(stratum, good, holdout, "r.*")

    def counted(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    g, h = F.col(good), F.col(holdout)
    parts = {"test_good": g & h, "learn_good": g & ~h, "learn_bad": ~g & ~h}
    reached = each.groupBy(stratum, "rule", "reached").agg(*(counted(c, name) for name, c in parts.items()))
    reached = stored(reached, "reached")
    # Rows that reach at least this cutoff, and all rows of the rule: a few dozen rows per stratum.
    steps = F.explode(F.sequence(F.lit(1), F.lit(max(len(c) for _, c in RULES.values())))).alias("step")
    sizes = reached.groupBy(stratum, "rule").agg(*(F.sum(name).alias(f"{name}_n") for name in parts))
    counts = (
        sizes.select("*", steps)
        .join(reached, [stratum, "rule"])
        .groupBy(stratum, "rule", "step", *(f"{name}_n" for name in parts))
        .agg(*(F.sum(F.when(F.col("reached") >= F.col("step"), F.col(name)).otherwise(0)).alias(name) for name in parts))
    )
    share = RISK / len(RULES)
    sequences = sizes.count()  # one for each stratum and rule
    lenient_first = Window.partitionBy(stratum, "rule").orderBy(F.desc("step"))
    tested = (
        counts.withColumn("p", F.max(binomial_tail(F.col("test_good"), F.col("test_good_n"), share)).over(lenient_first))
        .where(F.col("p") <= LEVEL / max(sequences, 1))
    )
    bad, fine = (F.col(f"learn_{x}") / F.greatest(F.col(f"learn_{x}_n"), F.lit(1)) for x in ("bad", "good"))
    strictest = tested.where(bad > LIFT * fine).groupBy(stratum, "rule").agg(F.min("step").alias("step"))
    cuts = F.create_map(*(x for name, (_, c) in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, c)))))
    return strictest.select(stratum, "rule", F.element_at(cuts[F.col("rule")], F.col("step")).alias("cutoff"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """Per document: `doc_id`, the measures, `base_failed`, `rejected_by` (rules of the stratum whose
    cutoffs it reaches) and `kept`."""
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")).alias("stratum"),
        F.col(text_col).alias("text"),
    )
    measured = stored(measures(read).drop("text"), "measures")
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        (F.min(label_col) == 1).alias("good")
    )
    labelled = measured.join(marks, "doc_id").withColumn("holdout", remainder(F.col("doc_id"), LEARNING_PARTS) != 0)
    found = stored(cutoffs(labelled, "stratum", "good", "holdout"), "cutoffs")
    # One row per stratum with enough labels to prove a cutoff: bounded by the labels, not the documents.
    by_stratum = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    judged = measured.join(F.broadcast(by_stratum), "stratum", "left")
    hits = F.array_compact(
        F.array(*(F.when(measure() >= F.get(F.array(F.col("cuts")[name]), 0), F.lit(name)) for name, (measure, _) in RULES.items()))
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("rejected_by", hits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
    )
