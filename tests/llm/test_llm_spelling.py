"""Operator 12 against a comparison of all words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import spelling
from riskweave.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    by_size = {}
    for word in n:
        by_size.setdefault(len(word), []).append(word)
    form, near = {}, {}
    for word in n:
        others = [v for size in (-1, 0, 1) for v in by_size.get(len(word) + size, ()) if one_apart(word, v)]
        near[word] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[word] = best if best is not None and n[best] >= 2 * n[word] else None
    out = {}
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (form[word], root, n[word], near[word], n.get(form[word]))
    return out


def rows_of(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark, sf_dir, documents):
    got = rows_of(QUERIES["op12_spelling"](spark, sf_dir))
    assert got == brute(counted(documents))
    assert sum(v[0] is not None for v in got.values()) > 20


def test_chains_ties_and_runs_of_equal_letters(spark):
    n = {
        # A chain of forms, each at least twice as frequent.
        "aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48,
        # Runs of equal letters: two words meet once.
        "bookkeeper": 10, "bookeeper": 3, "bokkeeper": 4, "bookkeepeer": 5, "boookkeeper": 5,
        # Equal frequencies: the smaller word in code-point order.
        "centra": 3, "centre": 9, "central": 9, "centrà": 9, "centrz": 9,
        "ÿÿÿÿÿ": 4, "ÿÿÿÿ×": 8, "alone": 7,
    }
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.spelling_variants(counts)) == brute(n)


WORDS = st.dictionaries(st.text("abà", min_size=5, max_size=7), st.integers(3, 40), max_size=60)


@settings(max_examples=8, deadline=None, database=None)
@given(WORDS)
def test_random_words(spark, n):
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.spelling_variants(counts)) == brute(n)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_groups_across_batches(spark, batch):
    n = {f"word{c}{d}": 3 + i * j for i, c in enumerate("abcdefgh") for j, d in enumerate("xyzà")}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert rows_of(spelling.spelling_variants(counts)) == brute(n)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counts_of_edge_texts(spark, edge_docs, no_docs, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] * 3
    everything = edge_docs.unionByName(edge_docs).unionByName(edge_docs)
    counts = spelling.word_counts(everything, typo_one_in=97).where("n >= 3")
    assert {r["word"]: r["n"] for r in counts.collect()} == counted(docs)
    assert spelling.spelling_variants(spelling.word_counts(no_docs)).isEmpty()


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PORTION", 10)
    text = "Straße of a hundred wörds, andaverylongwordoverthecut x " * 5
    cut = [w for part in spelling.portions(text) for w in spelling.RUN.findall(part)]
    assert cut == spelling.RUN.findall(text) and "".join(spelling.portions(text)) == text
