"""Operator 11 against a brute-force search of every window at every place."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave.llm import decontamination
from riskweave.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    """doc -> (words, set of hit words, sorted item ids)."""
    wanted = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(len(words) - size + 1, min(len(words), 1))):
            wanted.setdefault(tuple(words[at : at + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wanted}
    out = []
    for _, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                items_here = wanted.get(tuple(words[at : at + n]))
                if items_here:
                    hit.update(range(at, at + n))
                    found |= items_here
        out.append((words, hit, sorted(found)))
    return out


def test_query_equals_brute_force(spark, sf_dir, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op11_decontamination"](spark, sf_dir).collect()}
    assert len(got) == len(documents)
    hits = 0
    for (doc_id, _), (words, hit, found) in zip(documents, brute(documents, items), strict=True):
        row = got[doc_id]
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        expected = (len(words), len(hit), len(found), digest, bool(hit))
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"], row["contaminated"]) == expected
        hits += bool(hit)
    assert hits


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "two three four five six seven eight nine ten eleven"),
    (2, "Überraschung für ALLE!"),
    (3, "  ... "),
    (4, None),
    (None, "lonely"),
    (5, "aa aa aa aa aa aa aa aa aa aa aa"),
    (10, "10 20 30"),
]
TEXTS = [
    (1, "One, two\tthree FOUR five; six seven eight nine ten ELEVEN"),
    (2, "xone two three four five six seven eight nine ten"),
    (3, "two three four five six seven eight nine ten elevenx"),
    (4, "über überraschung - für\nalle? 10 20 30 40 überraschung für alle"),
    (5, None),
    (6, " aa" * 25),
    (7, "a lonely\x00lonely é日本語 lonely."),
    (7, "a lonely\x00lonely é日本語 lonely."),
    (None, ""),
    (9, "ÜBERRASCHUNG FÜR ALLE: 10 20.30"),
]


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 300, 20])
def test_any_number_of_automata_gives_equal_marks(spark, pattern_bytes):
    docs = spark.createDataFrame(
        [(i, *t, "x", 9) for i, t in enumerate(TEXTS)], "row long, doc_id long, text string, items string, part long"
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = decontamination.decontaminate(docs, items, max_pattern_bytes=pattern_bytes)
    got = sorted(marked.collect(), key=lambda r: r["row"])
    for row, (_, text), (words, hit, found) in zip(got, TEXTS, brute(TEXTS, ITEMS), strict=True):
        assert (row["n_words"], row["n_hit"], row["items"], row["part"]) == (len(words), len(hit), found, 9)
        inside = [i for r in row["hit_words"] for i in range(r["first"], r["last"] + 1)]
        assert inside == sorted(hit)
        for span, ranges in zip(row["hit_spans"], row["hit_words"], strict=True):
            assert words_of(text[span["start"] : span["end"]]) == words[ranges["first"] : ranges["last"] + 1]


def test_a_window_of_very_many_items_is_dealt_out(spark):
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.lit("same words in all").alias("text"))
    docs = spark.createDataFrame([(1, "the same words in all of them"), (2, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items, max_pattern_bytes=40_000).collect()}
    assert got[1]["items"] == sorted(map(str, range(3000))) and got[1]["n_hit"] == 4
    assert got[2]["items"] == [] and got[2]["hit_spans"] == []


def test_edges_and_empty_tables(spark, edge_docs, no_docs):
    texts = [(1, "The same text with odd"), (2, "word3 and 3"), (3, "one")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    no_items = items.where("item_id < 0")
    rows = decontamination.decontaminate(edge_docs, items).collect()
    assert len(rows) == edge_docs.count()
    marks = brute([(r["doc_id"], r["text"]) for r in rows], texts)
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == [(len(w), len(h), i) for w, h, i in marks]
    assert sum(r["n_hit"] > 0 for r in rows) >= 3
    assert decontamination.decontaminate(edge_docs, no_items).where("n_hit > 0 OR size(items) > 0").isEmpty()
    assert decontamination.decontaminate(no_docs, items).isEmpty()
