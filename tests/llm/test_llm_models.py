"""Quality rules (3), language model (4), toxicity (5), language ID (7)."""

import functools
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import bilinear_lm, language_id, quality, queries, toxicity
from riskweave.llm.common import remainder, stored
from riskweave.llm.rows import RowTable, summed

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_remainder_is_crc32_of_the_text(spark):
    rows = spark.createDataFrame([(0,), (17,), (-5,), (None,)], "id long").select("id", remainder(F.col("id"), 7).alias("r"))
    assert all(r["r"] == zlib.crc32(b"" if r["id"] is None else str(r["id"]).encode()) % 7 for r in rows.collect())


def test_row_table_starts_anew_when_full():
    made = []
    table = RowTable(lambda words: made.extend(words) or np.array([len(w) for w in words], dtype=float).reshape(-1, 1), size=5)
    for words in (["a", "bb", "a"], ["ccc", "dddd", "eeeee", "ffffff"], ["a", "bb"], []):
        rows = table.rows(words)
        assert table.values[rows].sum() == sum(map(len, words))
    assert made.count("a") == 2
    assert summed(np.ones((3, 2)), np.array([0, 2, 0, 1])).tolist() == [[0, 0], [2, 2], [0, 0], [1, 1]]


# Quality


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_equal_brute_force(spark, sf_dir, edge_docs):
    odd = ["a b c d e f g h i a b c d e f g h " * 3, "x " * 40, "1 2 3 4 5 6 7 8", "l\n\n l\nl\n \nl", "# $ % é\x0b日\x0c\x85", "w " * 7]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), edge_docs, made):
        for r in quality.measures(docs).collect():
            assert tuple(r[c] for c in MEASURES) == plain_measures(r["text"])


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 50), (3, 400), (0, 0), (7, 400), (12, 1000), (30, 1000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        exact = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["n"] == 0 or r["k"] > 0.02 * r["n"] else exact, rel=1e-9)


def labelled(spark, n, bad_symbols):
    """n good documents, 2 % of them with symbols, and n bad ones, each with `bad_symbols` of 100."""
    rows = [(i, "en", i % 50 == 0 and i % 2 == 0, True) for i in range(n)] + [(n + i, "en", True, False) for i in range(n)]
    docs = spark.createDataFrame([(k, s, bad_symbols if sym else 0, good, k % 3 != 0) for k, s, sym, good in rows], "doc_id long, stratum string, n_symbols int, good boolean, holdout boolean")
    return docs.withColumns({c: F.lit(100) for c in ("word_chars", "n_words", "n_lines")} | {c: F.lit(0) for c in ("n_dup_lines", "n_repeat_words")})


def test_cutoffs_are_proven_and_useful(spark):
    many = quality.cutoffs(labelled(spark, 6000, 30), "stratum", "good", "holdout").collect()
    assert many == []  # 2 % of good documents would go, more than a rule's share of the risk
    none_good = labelled(spark, 6000, 30).where("NOT (good AND n_symbols > 0)")
    (one,) = quality.cutoffs(none_good, "stratum", "good", "holdout").collect()
    assert (one["stratum"], one["rule"]) == ("en", "symbol_share") and 0 < one["cutoff"] <= 0.30
    few = quality.cutoffs(none_good.where("doc_id % 40 = 0"), "stratum", "good", "holdout").collect()
    assert few == []  # too few labels to prove anything


def test_op3_keeps_what_no_rule_rejects(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, sf_dir).collect()}
    for key, text in documents:
        m = plain_measures(text)
        assert tuple(got[key][c] for c in MEASURES) == m
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        assert got[key]["base_failed"] == failed
        assert got[key]["kept"] == (not failed and not got[key]["rejected_by"])


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(edge_docs, labels)
    assert got.count() == edge_docs.count()
    assert {r["kept"] for r in got.where("doc_id = 8").collect()} == {False}
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(edge_docs, labels.limit(0)).count() == edge_docs.count()


# Language model


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def plain_base(train, text):
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    own = tokens(text)
    return len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)


def test_op4_base_is_exact_and_the_model_better(spark, sf_dir, documents):
    train = [t for k, t in documents if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.op4_bilinear_lm(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for key, text in documents:
        r, own = got[key], tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 7 == 2)
    apart = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_model_is_normalised_and_rare_words_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    few, many = (bilinear_lm.fit(docs, words=100, known=k, steps=5) for k in (150, 100_000))
    assert len(few.known) <= 150 < len(many.known)
    assert np.allclose((10.0 ** few.log10.astype(float)).sum(axis=1), 1, atol=1e-4)
    a, b = ({r["doc_id"]: r for r in bilinear_lm.score(docs, m).collect()} for m in (few, many))
    for key, r in a.items():
        assert r["n_known"] == b[key]["n_known"]
        for c in ("score", "base_score"):
            assert r[c] == pytest.approx(b[key][c], abs=1e-6)
    # The words of each class share its probability, one share left for the unseen.
    counts = {bytes(r["word"]): r["n"] for r in many.counts.collect()}
    vocabulary = {w for w, (t, _) in many.known.items() if t < len(many.log10) - 1 - bilinear_lm.CLASSES}
    share = Counter()
    for word, n in counts.items():
        if word not in vocabulary and word != bilinear_lm.END:
            share[bilinear_lm.word_class(word)] += n + 1
    assert all(many.class_size[k] == n + 1 for k, n in share.items())


def test_vocabulary_grows_and_blocks_sum_to_the_whole(spark, monkeypatch):
    rng = random.Random(3)
    # Words of number k come about 1 / k as often as the first.
    names = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choices(names, [1 / (k + 1) for k in range(4000)], k=400)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(bilinear_lm, "WORDS", 20)
    sizes = [sum(t < m.end - bilinear_lm.CLASSES for t, _ in m.known.values()) for m in (bilinear_lm.fit(d, steps=1) for d in (docs.where("doc_id < 6"), docs))]
    assert 20 < sizes[0] < sizes[1] <= math.isqrt(60 * 401)
    assert bilinear_lm.vocabulary_size(10**8) == 10**4
    # Steps over many blocks equal those over one.
    models = []
    for cells in (1 << 19, 2000):
        monkeypatch.setattr(bilinear_lm, "CELLS", cells)
        models.append(bilinear_lm.fit(docs, steps=4))
    one, many = models
    assert np.allclose(one.log10, many.log10, atol=1e-3)
    assert np.allclose((10.0 ** many.log10).sum(axis=1), 1, atol=1e-4)


def test_gradients_are_added_up_before_they_reach_the_driver(spark, monkeypatch):
    size, rng = 2500, np.random.default_rng(6)
    monkeypatch.setattr(bilinear_lm, "CELLS", size * 100)
    shapes = (size, bilinear_lm.DIMENSIONS), (size, bilinear_lm.DIMENSIONS), size
    values = [rng.normal(0, 0.1, shape).astype(np.float32) for shape in shapes]
    pairs = spark.createDataFrame([(int(p), 1) for p in rng.choice(size * size, 3000, replace=False)], "pair long, n long")
    blocks = stored(bilinear_lm.pair_blocks(pairs, size).repartition(4), "blocks")
    unigram = np.full(size, 1 / size)
    sent = []
    frame = type(blocks)
    collect, to_arrow = frame.collect, frame.toArrow
    monkeypatch.setattr(frame, "collect", lambda self: [sent.append(len(r["gradient"])) or r for r in collect(self)])
    monkeypatch.setattr(frame, "toArrow", lambda self: [t := to_arrow(self), sent.extend(len(g) for g in t["gradient"].to_pylist())][0])
    found = bilinear_lm.summed_gradients(blocks, values, unigram, 3000.0)
    monkeypatch.undo()
    assert sum(sent) == sum(v.nbytes for v in values) and max(sent) < 1 << 18
    # All at once, in one block.
    context, target, bias = values
    at = np.array([r["pair"] for r in pairs.collect()])
    slope = bilinear_lm.block_slope(context, target, bias, unigram, at, np.full(len(at), 1 / 3000.0))
    for got, expected in zip(found, (slope @ target, slope.T @ context, slope.sum(axis=0)), strict=True):
        assert np.allclose(got, expected, rtol=1e-3, atol=1e-6)


def test_neighbours_reach_spark_by_block_and_not_pair_by_pair(spark, monkeypatch):
    rng = random.Random(9)
    ends = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0"]
    pieces = ["a", "B", "zZ", "Zq", "é", "É", "日本", "\x00", "word", "Other", *ends]
    texts = [None, "", " \n", "a", *("".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(300))]
    monkeypatch.setattr(bilinear_lm, "PORTION", 70)
    monkeypatch.setattr(bilinear_lm, "GATHERED", 150)
    monkeypatch.setattr(bilinear_lm, "CELLS", 400)
    portions = list(bilinear_lm.split(pa.array(["x", *texts]).slice(1)))
    assert len(portions) > 20
    words = [w for found, _ in portions for w in found.to_pylist()]
    assert words == [w for t in texts for w in tokens(t)[:-1]]
    assert [n for _, counts in portions for n in counts.tolist()] == [len(tokens(t)) - 1 for t in texts]
    for found, _ in portions:
        assert bilinear_lm.word_classes(found).tolist() == [bilinear_lm.word_class(w) for w in found.to_pylist()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = Counter(t for x in texts for t in tokens(x))
    assert {bytes(r["word"]): r["n"] for r in bilinear_lm.token_counts(docs).collect()} == dict(counts)

    kept = {}
    monkeypatch.setattr(bilinear_lm, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    model = bilinear_lm.fit(docs, words=12, steps=1)
    assert set(kept) == {"token-counts", "pair-blocks"}
    size = len(model.bias)
    number = {w: t for w, (t, _) in model.known.items()} | {b"\n": size - 1}
    pairs = Counter()
    for text in texts:
        own = [size - 1, *(number[t] for t in tokens(text))]
        pairs.update(zip(own, own[1:]))
    rows, blocks, found = kept["pair-blocks"].collect(), bilinear_lm.block_count(size), {}
    assert 1 < len(rows) == len({r["block"] for r in rows}) <= blocks
    for r in rows:
        at, n = np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["n"], dtype=np.int64)
        found |= {(int(a) // size * blocks + r["block"], int(a) % size): int(k) for a, k in zip(at, n, strict=True)}
    assert found == dict(pairs)


def test_lm_edges(spark, edge_docs, no_docs):
    model = bilinear_lm.fit(edge_docs, steps=3)
    texts = [r["text"] for r in edge_docs.collect()]
    got = bilinear_lm.score(edge_docs, model).collect()
    assert sorted((r["n_tokens"], r["n_known"]) for r in got) == sorted(plain_base(texts, t)[:2] for t in texts)
    blank = bilinear_lm.fit(no_docs, steps=3)
    assert {(r["n_known"], r["train_tokens"]) for r in bilinear_lm.score(edge_docs, blank).collect()} == {(0, 0)}
    assert bilinear_lm.score(no_docs, model).count() == 0


# Toxicity


def toxic_rows(n, seed=4):
    rng = random.Random(seed)
    plain = [a + b for a in ("ta", "re", "mi", "so", "lu", "ve") for b in ("nd", "rth", "ly", "ous", "m", "p")]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if bad := i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["scum", "Vile", "rotten,"])
        out.append((i, " ".join(words), "de" if i % 3 else "en", int(bad)))
    return out


def test_toxicity_learns_and_holds_out(spark):
    rows = spark.createDataFrame(toxic_rows(900), "doc_id long, text string, lang string, toxic int")
    net = toxicity.fit(rows.where("doc_id % 3 != 1"), rows)
    scored = toxicity.score(rows.where("doc_id % 3 = 1"), net, lang_col="lang").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in scored]) > 0.97
    assert np.mean([r["rejected"] == (r["toxic"] == 1) for r in scored]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_long_texts_teach_and_characters_bound_the_sample(spark, monkeypatch):
    long = "plain " * 30_000
    rows = [(i, t + long * (i % 2), g, b) for i, t, g, b in toxic_rows(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    taught = []

    def noted(rows_of, ids, labels, seed=11):
        taught.append(sum(len(i) > 30_000 for i in ids))
        return toxicity.Network.fresh(seed)

    monkeypatch.setattr(toxicity, "train", noted)
    toxicity.fit(df, df)
    toxicity.fit(df, df, characters=1_000_000)
    assert taught[0] > 10 and 0 < taught[1] < taught[0]


def test_all_labelled_texts_teach_whatever_training_starts_with(spark, monkeypatch):
    rows = spark.createDataFrame(toxic_rows(3000), "doc_id long, text string, lang string, toxic int")
    teach, held_out = rows.where("doc_id % 3 != 1"), rows.where("doc_id % 3 = 1")
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    blocks = []
    whole = toxicity.taught

    def noted(learn, net):
        done = whole(learn, net)
        blocks.append(([r["texts"] for r in done.select("texts").collect()], learn.select("text").distinct().count()))
        return done

    monkeypatch.setattr(toxicity, "taught", noted)
    # Ids that repeat and null ones neither teach twice nor get in the way.
    net = toxicity.fit(teach.union(teach.limit(50)).union(teach.limit(9).withColumn("doc_id", F.lit(None))), rows, sample={0: 4, 1: 4})
    texts, distinct = blocks[0]
    assert len(texts) > 1 and sum(texts) == distinct
    scored = toxicity.score(held_out, net, lang_col="lang").collect()
    assert np.mean([r["rejected"] == (r["toxic"] == 1) for r in scored]) > 0.97


def test_all_texts_apart_calibrate(spark):
    net = toxicity.Network.fresh(3)
    net.embeddings[:] *= 30
    rows = [(f"w{i % 40} w{i % 7}", "ab"[i % 2] if i % 9 else None, int(i % 40 < 8)) for i in range(4000)]
    check = spark.createDataFrame(rows, "text string, lang string, label int")
    scores = {r["text"]: r["score"] for r in toxicity.score(check, net).collect()}
    raw = np.array([np.log(scores[t] / (1 - scores[t])) for t, _, _ in rows])
    labels, langs = np.array([float(y) for _, _, y in rows]), np.array([g for _, g, _ in rows])
    toxicity.calibrate(check, net)
    ones = np.ones(len(rows))
    scale, shift = toxicity.platt(raw, labels, ones)
    assert net.scale == pytest.approx(scale, rel=0.02) and net.shift == pytest.approx(shift, rel=0.02, abs=0.02)
    expected = toxicity.sigmoid(net.scale * raw + net.shift)
    for lang in (None, "a", "b"):
        own = langs == lang if lang else ones > 0
        assert net.thresholds[lang] == pytest.approx(toxicity.best_threshold(expected[own], labels[own], ones[own]), abs=0.01)


def test_toxicity_score_ignores_label_language_and_neighbours(spark):
    rows = spark.createDataFrame(toxic_rows(300), "doc_id long, text string, lang string, toxic int")
    net = toxicity.fit(rows, rows)
    alone = {r["doc_id"]: r["score"] for r in toxicity.score(rows.where("doc_id < 9").withColumn("lang", F.lit("xx")), net).collect()}
    among = {r["doc_id"]: r["score"] for r in toxicity.score(rows.drop("toxic", "lang"), net).collect()}
    assert all(among[k] == pytest.approx(v, abs=1e-6) for k, v in alone.items())


def test_convolution_equals_a_loop():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(1)
    counts = np.array([0, 1, 5, 0, 2])
    words = rng.normal(size=(8, toxicity.DIMENSIONS)).astype(np.float32)
    got, at = toxicity.logits(words, counts, net), 0
    for k, n in enumerate(counts):
        text = np.concatenate([words[at : at + n], np.zeros((4, toxicity.DIMENSIONS), np.float32)])
        best = []
        for width, slices in zip(toxicity.WIDTHS, toxicity.tap_slices(), strict=True):
            places = [sum(text[i + j] @ net.taps[:, s] for j, s in enumerate(slices)) for i in range(max(n, 1))]
            best.append(np.max(places, axis=0))
            assert len(slices) == width
        assert got[k] == pytest.approx(np.maximum(np.concatenate(best) + net.bias, 0) @ net.out + net.out_bias, rel=1e-4)
        at += n


def test_gradient_of_the_network():
    net, rng = toxicity.Network.fresh(2), np.random.default_rng(5)
    rows_of = toxicity.features(["alpha", "beta", "gamma", "delta"])
    ids, labels = [rng.integers(0, 4, 6), rng.integers(0, 4, 3)], np.array([1.0, 0.0])

    def loss():
        x = toxicity.logits(np.concatenate([net.embeddings[rows_of[i]].sum(axis=1) for i in ids]), np.array([6, 3]), net)
        p = toxicity.sigmoid(x)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    seen = {}

    class Recorder:
        def step(self, k, value, gradient, rows=None):
            seen[k] = (gradient, rows)

    before = net.out_bias
    toxicity.gradient_step(net, Recorder(), rows_of, ids, labels)
    net.out_bias = before
    for k, value, at in ((1, net.taps, (3, 7)), (3, net.out, (5,)), (2, net.bias, (4,))):
        kept, h = value[at], 1e-2
        value[at] = kept + h
        up = loss()
        value[at] = kept - h
        slope = (up - loss()) / (2 * h)
        value[at] = kept
        assert seen[k][0][at] == pytest.approx(slope, abs=2e-4)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labelled = edge_docs.withColumn("toxic", (F.col("n_chars") % 2).cast("int"))
    net = toxicity.fit(edge_docs, labelled)
    scored = toxicity.score(edge_docs, net, lang_col="lang")
    assert scored.count() == edge_docs.count() and scored.where("score BETWEEN 0 AND 1 AND rejected IS NOT NULL").count() == scored.count()
    assert toxicity.score(no_docs, net).count() == 0
    nothing = toxicity.fit(edge_docs, labelled.limit(0))
    assert {(round(r["score"], 6), r["rejected"]) for r in toxicity.score(edge_docs, nothing, lang_col="lang").collect()} == {(0.0, False)}


# Language identification


def test_forward_and_backward_sum_all_segmentations(monkeypatch):
    pieces = language_id.Pieces(PIECES)
    rng = np.random.default_rng(1)
    p = rng.random(pieces.unknown + 1)
    spans = ["▁the", "▁日x", "▁a", "zzz", "▁" + "q" * 20, "▁" + "antidis" * 40]
    alpha, beta = language_id.nothing_yet(spans), language_id.nothing_yet(spans)
    lengths = np.array([len(s) for s in spans])
    alpha[:, 0], beta[np.arange(len(spans)), lengths] = 0, 0
    monkeypatch.setattr(language_id, "STARTS", 7)  # portions end inside of words
    lattice = list(pieces.lattice(spans))
    assert len(lattice) == -(-lengths.max() // 7)
    for edges in lattice:
        language_id.forward(alpha, edges, np.log(p[edges[:, 3]]))
    for edges in reversed(lattice):
        language_id.backward(beta, edges, np.log(p[edges[:, 3]]))

    def total(span):
        sums = [1.0]
        for end in range(1, len(span) + 1):
            value = 0.0
            for start in range(end):
                sub = span[start:end]
                if sub in pieces.numbers:
                    value += sums[start] * p[pieces.numbers[sub]]
                elif len(sub) == 1:
                    value += sums[start] * p[pieces.unknown]
            sums.append(value)
        return sums[-1]

    for k, span in enumerate(spans):
        log = pytest.approx(math.log(total(span)), rel=1e-9)
        assert alpha[k, len(span)] == log and beta[k, 0] == log


def test_edges_are_all_pieces_and_found_for_all_words_at_once():
    pieces = language_id.Pieces(PIECES)
    words = ["▁the", "▁überall", "x", "", "日本語👍", "\ud800a", "▁" + "abc" * 9, "▁den", "zzzz\x00q"]
    expected = []
    for first, last in ((0, 4096), (3, 7)):
        for k, word in enumerate(words):
            for i in range(first, min(len(word), last)):
                for j in range(i + 1, len(word) + 1):
                    piece = pieces.numbers.get(word[i:j], pieces.unknown if j == i + 1 else None)
                    if piece is not None:
                        expected.append((i, k, j, piece))
        found = [(i, k, j, piece) for k, i, j, piece in pieces.edges(words, first, last).tolist()]
        assert found == sorted(expected)
        expected.clear()

    def calls(words):
        count = Counter()
        sys.setprofile(lambda frame, event, of: count.update([getattr(of, "__name__", "")]) if event == "c_call" else None)
        try:
            pieces.edges(words, 0, 4096)
        finally:
            sys.setprofile(None)
        return count.total() - count["len"]

    assert calls(["▁unterwegs"] * 1000) < calls(["▁unterwegs"]) + 20


def test_words_of_any_length_are_scored_whole():
    pieces = language_id.Pieces(PIECES)
    p = np.random.default_rng(3).random((pieces.unknown + 1, 2)) * 1e-6
    scorer = language_id.Scorer({"path": PIECES, "p": p})
    words = ["short", "donaudampfschifffahrt" * 300, "x" * 9000, "日本語" * 50, "tail"]
    got = scorer.word_rows(words)
    for word, row in zip(words, got, strict=True):
        word = "▁" + word
        logs = np.full((len(word) + 1, 2), -np.inf)
        logs[0] = 0
        for start in range(len(word)):
            for end in range(start + 1, min(len(word), start + pieces.longest) + 1):
                number = pieces.numbers.get(word[start:end], pieces.unknown if end == start + 1 else None)
                if number is not None:
                    logs[end] = np.logaddexp(logs[end], logs[start] + np.log(p[number]))
        assert row[:2] == pytest.approx(logs[-1], rel=1e-9) and row[2] == len(word)


def test_blocks_hold_every_word_once():
    rng = np.random.default_rng(4)
    words = ["w" * int(n) for n in [*rng.integers(1, 40, 20_000), 300_000, 1]]
    found = list(language_id.blocks(words))
    assert sorted(i for block in found for i in block) == list(range(len(words)))
    assert all(len(b) == 1 or len(b) * max(len(words[i]) for i in b) <= language_id.PLACES for b in found)
    assert all(len(b) <= language_id.BLOCK for b in found) and list(language_id.blocks([])) == []


def test_prediction_equals_a_plain_forward_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, PIECES, rounds=1, sample=20)
    pieces, logs = language_id.Pieces(PIECES), np.log(model.probabilities)

    @functools.cache
    def plain(word):
        word = "▁" + (word.strip(language_id.EDGE).lower() or word)
        at = [np.zeros(len(model.languages))]
        for end in range(1, len(word) + 1):
            parts = []
            for start in range(max(0, end - pieces.longest), end):
                number = pieces.numbers.get(word[start:end], pieces.unknown if end == start + 1 else None)
                if number is not None:
                    parts.append(at[start] + logs[number])
            at.append(np.logaddexp.reduce(parts))
        return at[-1], len(word)

    for r in language_id.predict(docs, model, rate_col="rate").where("doc_id % 7 = 0").collect():
        if r["lang_pred"] != "und":
            found = [plain(w) for w in r["text"].split()]
            total = sum(x for x, _ in found)
            assert r["lang_pred"] == model.languages[int(total.argmax())]
            assert r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)
            assert r["rate"] == pytest.approx(total.max() / sum(n for _, n in found), rel=1e-9)


def test_texts_of_no_learned_language_are_not_ordinary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, PIECES)
    odd = {
        -1: "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4,
        -2: "いろはにほへと ちりぬるを わかよたれそ つねならむ " * 4,
        -3: "qzxv jkwq vbnmx zxcvq wqkjh ghjkz pqxzw mnbvq lkjhz qwxz " * 4,
        -4: "aaaaa bbbbb ccccc ddddd " * 8,
        -5: "12 34",
    }
    rows = docs.unionByName(spark.createDataFrame([(k, t, None) for k, t in odd.items()], docs.schema))
    got = language_id.ordinary(language_id.predict(rows, model, rate_col="rate"), "rate", "ordinary").collect()
    assert {r["doc_id"] for r in got if r["doc_id"] < 0 and r["ordinary"]} == set()
    clean = [r for r in got if r["doc_id"] >= 0 and r["lang_pred"] != "und"]
    assert sum(r["ordinary"] for r in clean) >= 0.99 * len(clean)


def test_op7_on_held_out_documents(spark, sf_dir):
    got = queries.op7_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows} == {True}
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97


def test_language_edges(spark, edge_docs, no_docs, sf_dir):
    model = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), PIECES, rounds=2, sample=10)
    got = language_id.predict(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    assert language_id.predict(no_docs, model).count() == 0
    unlearned = language_id.fit(no_docs, PIECES)
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(edge_docs, unlearned).collect()} == {("und", 1.0)}
