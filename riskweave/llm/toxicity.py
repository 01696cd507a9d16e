"""Toxicity (operator 5): a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: the whole word, its beginnings of three to seven characters and
its last four characters. Filters of several widths run over the words of the whole text, the largest response of each is
kept, and a logistic layer gives the probability. Texts of any length are read whole.

Every labelled text teaches, once however often it is repeated; of its labels the highest counts. Four fifths
of the texts, by a hash, set the weights. Training starts on the driver with at most about `SAMPLE` of them of each
label, in the order of a hash and while those before them have at most `CHARACTERS` together. From there all
of them teach in Spark tasks: they are stored in blocks, each block trains the network on its texts, one after the
other, and the networks of all blocks are averaged, a row of the embeddings by how often a block moved it and the rest
by the block's texts. On the other fifth, all of it, the logit is rescaled (Platt), and the threshold of each
language is set, the one of best F1 over its texts; Spark counts these texts by label, language and logit, in steps of
1/`FINENESS`.
A language with fewer than `CALIBRATING` toxic texts there takes the threshold of all languages
together, and if these have too few, it is `UNSURE`. Languages only choose thresholds; they are no input of the score.

A null or empty text has no words and gets the score of a pad word. Unlabelled rows and rows with a null
label teach nothing; without both labels among the texts, every score is the share of toxic labels (0
if there are none) and nothing is rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import stored
from riskweave.llm.pieces import of_worker
from riskweave.llm.rows import RowTable, portions

SAMPLE, CHARACTERS, CALIBRATING = {0: 3000, 1: 2000}, 40_000_000, 20
HASHED, DIMENSIONS = 1 << 16, 24
PREFIXES = (3, 4, 5, 6, 7)
WIDTHS, FILTERS = (1, 2, 3), 16
EPOCHS, MINIBATCH, RATE = 8, 32, 0.1
#: Texts of a block to teach with, and blocks at most: the driver adds up one network of each.
BLOCK, BLOCKS = 8000, 64
#: Labels, or labelled texts, that are broadcast to find their rows. More are joined by a shuffle.
BROADCAST = 1_000_000
#: Steps of the logit, from -30 to 30, in which the calibrating texts are counted.
FINENESS = 256
#: Scores from here on are predicted toxic, whatever the language; fixed by the contract.
THRESHOLD = 0.3
#: The threshold for rejection while there are too few labels to set one.
UNSURE = 0.5
EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_"
#: Sums of what stands before a word's end and its beginnings, to be continued.
LAST, BEGINS = crc32(b"$"), [(n, crc32(b"%d^" % n)) for n in PREFIXES]


def features(words: list[str]) -> np.ndarray:
    """Embedding rows of each word; row 0 is the pad."""
    sums: list[int] = []
    for word in words:
        word = word.strip(EDGE) or word
        own = word.encode()
        if len(own) == len(word):
            sums += (crc32(own), crc32(own[-4:], LAST), *[crc32(own[:n], begin) for n, begin in BEGINS])
        else:
            sums += (crc32(own), crc32(word[-4:].encode(), LAST), *[crc32(word[:n].encode(), begin) for n, begin in BEGINS])
    return 1 + np.array(sums, dtype=np.int64).reshape(len(words), 2 + len(PREFIXES)) % (HASHED - 1)


def split(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Network:
    embeddings: np.ndarray
    taps: np.ndarray  # [dimension, all (width, place, filter)]
    bias: np.ndarray  # [filter of each width]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    sums: list | None = None  # of squared gradients, to train on

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        embeddings = rng.normal(0, 0.1, (HASHED, DIMENSIONS)).astype(np.float32)
        embeddings[0] = 0
        taps = rng.normal(0, 0.3, (DIMENSIONS, sum(WIDTHS) * FILTERS)).astype(np.float32)
        n = len(WIDTHS) * FILTERS
        return Network(embeddings, taps, np.zeros(n, np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0)

    def plain(self) -> dict:
        """For a broadcast: workers need no class."""
        return {k: getattr(self, k) for k in ("embeddings", "taps", "bias", "out", "out_bias", "scale", "shift")}


def tap_slices() -> list[list[slice]]:
    """Columns of `taps` for each width and place in it."""
    out, at = [], 0
    for width in WIDTHS:
        out.append([slice(at + k * FILTERS, at + (k + 1) * FILTERS) for k in range(width)])
        at += width * FILTERS
    return out


def laid_out(words: np.ndarray, counts: np.ndarray):
    """Word vectors of texts one after another with pads between; the first place and the number of places
    of each text, at least one."""
    places = np.maximum(counts, 1)
    gap = max(WIDTHS) - 1
    first = np.cumsum(places + gap) - (places + gap)
    laid = np.zeros((int((places + gap).sum()), DIMENSIONS), dtype=np.float32)
    laid[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(words))] = words
    return laid, first, places


def responses(laid: np.ndarray, slices: list[slice], net: Network) -> np.ndarray:
    """Responses of the filters of one width, without bias, at all places."""
    n = len(laid) - max(WIDTHS) + 1
    total = laid[:n] @ net.taps[:, slices[0]]
    for k, s in enumerate(slices[1:], 1):
        total += laid[k : n + k] @ net.taps[:, s]
    return total


def logits(words: np.ndarray, counts: np.ndarray, net: Network) -> np.ndarray:
    laid, first, places = laid_out(words, counts)
    # Runs alternate between the places of a text and the pads behind it, which are left out.
    edges = np.stack([first, first + places], axis=1).ravel()
    edges = edges[edges < len(laid) - max(WIDTHS) + 1]
    tops = [np.maximum.reduceat(responses(laid, s, net), edges, axis=0)[::2] for s in tap_slices()]
    return np.maximum(np.concatenate(tops, axis=1) + net.bias, 0) @ net.out + net.out_bias


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adagrad:
    def __init__(self, net: Network):
        values = (net.embeddings, net.taps, net.bias, net.out)
        self.sums = net.sums or [np.full(v.shape, 1e-3, dtype=np.float32) for v in values]
        self.moves = np.zeros(len(net.embeddings), dtype=np.int32)  # of each row of the embeddings

    def step(self, k: int, value: np.ndarray, gradient: np.ndarray, rows=None) -> None:
        if rows is None:
            self.sums[k] += gradient**2
            value -= RATE * gradient / np.sqrt(self.sums[k])
        else:
            self.moves[rows] += 1
            self.sums[k][rows] += gradient**2
            value[rows] -= RATE * gradient / np.sqrt(self.sums[k][rows])


def train(rows_of: np.ndarray, ids: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Network:
    """`rows_of`: feature rows [word, feature]; `ids`: the words of each text."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    net.out_bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    optimiser = Adagrad(net)
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), MINIBATCH):
            own = order[at : at + MINIBATCH]
            gradient_step(net, optimiser, rows_of, [ids[i] for i in own], labels[own])
    net.sums = optimiser.sums
    return net


def gradient_step(net: Network, optimiser: Adagrad, rows_of: np.ndarray, ids: list[np.ndarray], labels: np.ndarray) -> None:
    counts = np.array([len(x) for x in ids])
    distinct, words = np.unique(np.concatenate(ids), return_inverse=True)
    rows = rows_of[distinct]
    laid, first, places = laid_out(net.embeddings[rows].sum(axis=1)[words], counts)
    found = np.concatenate([responses(laid, s, net) for s in tap_slices()], axis=1) + net.bias
    n = len(ids)
    top_at = np.stack([first[i] + found[first[i] : first[i] + places[i]].argmax(axis=0) for i in range(n)])
    top = np.take_along_axis(found, top_at, axis=0)
    hidden = np.maximum(top, 0)
    error = ((sigmoid(hidden @ net.out + net.out_bias) - labels) / n).astype(np.float32)
    through = error[:, None] * net.out * (top > 0)  # [text, filter]
    optimiser.step(3, net.out, error @ hidden)
    net.out_bias -= RATE * float(error.sum())
    taps = np.zeros_like(net.taps)
    word_of = np.full(len(laid), -1)
    word_of[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(words))] = words
    touched, pushed = [], []
    for w, slices in enumerate(tap_slices()):
        own = slice(w * FILTERS, (w + 1) * FILTERS)
        for k, s in enumerate(slices):
            at = top_at[:, own] + k
            g = through[:, own]
            taps[:, s] = np.einsum("tf,tfd->df", g, laid[at])
            touched.append(word_of[at].ravel())
            pushed.append((g[:, :, None] * net.taps[:, s].T[None]).reshape(-1, DIMENSIONS))
    at_word, push = np.concatenate(touched), np.concatenate(pushed)
    real = at_word >= 0
    spread = rows[at_word[real]]  # every feature row of a word gets the word's gradient
    order = np.argsort(spread, axis=None, kind="stable")
    where, begins = np.unique(spread.ravel()[order], return_index=True)
    optimiser.step(1, net.taps, taps)
    optimiser.step(2, net.bias, through.sum(axis=0))
    if len(where):
        gradient = np.add.reduceat(push[real][order // spread.shape[1]], begins, axis=0)
        optimiser.step(0, net.embeddings, gradient, where)


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit that fit the labels, by Newton steps with a weak prior at (1, 0)."""
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = sigmoid(design @ w)
        gradient = design.T @ (weight * (p - y)) + 0.1 * (w - [1.0, 0.0])
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        w = w - np.linalg.solve(curvature, gradient)
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (1.0, 0.0)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at the cut of best F1."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weight[order]
    f1 = 2 * np.cumsum(y * w) / (np.cumsum(w) + (y * w).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # ties stand or fall together
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def teaching_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str) -> DataFrame:
    """(block, h, apart, label, lang, text), stored: all distinct labelled texts, in each block by their hash."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    marks = stored(marks.agg(F.max(label_col).cast("int").alias("label")), "marks")
    read = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(text_col).alias("h"),
    )
    # Copies are told apart by hashes, so that of each text only one row is shuffled.
    found = read.select("__id", "lang", "h").join(small(marks, marks.count()), "__id")
    one = found.groupBy("h").agg(F.min("__id").alias("__id"), F.max("label").alias("label"), F.min("lang").alias("lang"))
    one = stored(one, "labelled-texts")
    n = one.count()
    blocks = min(BLOCKS, 1 + n // BLOCK)
    texts = read.select("__id", "h", "text").join(small(one, n), ["__id", "h"])
    laid = texts.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).repartition(blocks, "block")
    laid = laid.dropDuplicates(["block", "h"]).sortWithinPartitions("block", "h")
    apart = F.pmod(F.xxhash64(F.lit("apart"), "h"), F.lit(5)) == 4
    return stored(laid.select("block", "h", apart.alias("apart"), "label", "lang", "text"), "teaching-texts")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def start(learn: DataFrame, sizes: dict[int, int], sample: dict[int, int], characters: int) -> Network:
    """A network trained on the driver with a bounded part of the texts, for `sweep` to go on from."""
    share = {k: min(1.0, sample[k] / max(n, 1)) for k, n in sizes.items()}
    limit = F.when(F.col("label") == 1, int(share.get(1, 0) * (1 << 30))).otherwise(int(share.get(0, 0) * (1 << 30)))
    few = learn.where(F.pmod(F.xxhash64(F.lit("start"), "h"), F.lit(1 << 30)) < limit)
    few = stored(few.orderBy("h").limit(2 * sum(sample.values())), "first-texts")
    lengths = few.select("h", F.length("text").alias("length")).orderBy("h").toPandas()
    within = lengths["h"][lengths["length"].cumsum() - lengths["length"] <= characters]
    if not len(within):
        return Network.fresh()
    texts = few.where(F.col("h") <= int(within.max())).orderBy("h").toPandas()
    labels = texts["label"].to_numpy(dtype=np.float64)
    numbers: dict[str, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in split(t)], dtype=np.int64) for t in texts["text"]]
    net = train(features(list(numbers)), words, labels)
    # From the odds among these texts to those among all.
    toxic = labels.sum()
    net.out_bias += float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1) * (len(labels) - toxic + 1) / (toxic + 1)))
    return net


def taught(learn: DataFrame, net: Network) -> DataFrame:
    """(texts, moves, embeddings, others), stored: the network after the texts of each block, from `net` on."""
    shared = learn.sparkSession.sparkContext.broadcast(net.plain() | {"sums": net.sums})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RowTable(features)
        block, learner = None, None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and (learner is None or block != blocks[a]):
                    if learner:
                        yield learner.result()
                    block, learner = blocks[a], Learner(shared.value)
                own = batch.slice(a, b - a)
                learner.learn(table, own.column("text"), own.column("label").to_numpy().astype(np.float64))
        if learner:
            yield learner.result()

    done = stored(learn.select("block", "label", "text").mapInArrow(run, "texts long, moves binary, embeddings binary, others binary"), "taught")
    shared.destroy()
    return done


class Learner:
    """A network that goes on training from a shared one."""

    def __init__(self, shared: dict):
        own = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in shared.items()}
        own["sums"] = own["sums"] and [v.copy() for v in own["sums"]]
        self.net = Network(**own)
        self.optimiser, self.texts = Adagrad(self.net), 0

    def learn(self, table: RowTable, texts: pa.Array, labels: np.ndarray) -> None:
        at = 0
        for words, counts in portions(texts, split):
            ids = np.split(table.rows(words), np.cumsum(counts)[:-1])
            for k in range(0, len(ids), MINIBATCH):
                few = ids[k : k + MINIBATCH]
                gradient_step(self.net, self.optimiser, table.values, few, labels[at : at + len(few)])
                at += len(few)
        self.texts += at

    def result(self) -> pa.RecordBatch:
        others = np.concatenate([np.ravel(x) for x in others_of(self.net)]).astype(np.float32)
        parts = [self.optimiser.moves, self.net.embeddings, others]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.texts]), *(pa.array([x.tobytes()], type=pa.binary()) for x in parts)],
            names=["texts", "moves", "embeddings", "others"],
        )


def others_of(net: Network) -> list:
    return [net.taps, net.bias, net.out, net.out_bias]


def sweep(learn: DataFrame, net: Network) -> Network:
    """`net` after all texts: the average of the blocks. One of their networks at a time is on the driver."""
    moves, texts = np.zeros(len(net.embeddings)), 0
    embeddings = np.zeros(net.embeddings.shape)
    others = np.zeros(sum(np.size(x) for x in others_of(net)))
    for row in taught(learn, net).toLocalIterator():
        own = np.frombuffer(row["moves"], dtype=np.int32)
        embeddings += own[:, None] * np.frombuffer(row["embeddings"], dtype=np.float32).reshape(embeddings.shape)
        others += row["texts"] * np.frombuffer(row["others"], dtype=np.float32)
        moves += own
        texts += row["texts"]
    if not texts:
        return net
    moved = moves > 0
    net.embeddings[moved] = embeddings[moved] / moves[moved, None]
    others = (others / texts).astype(np.float32)
    a, b = net.taps.size, net.taps.size + net.bias.size
    net.taps, net.bias = others[:a].reshape(net.taps.shape), others[a:b]
    net.out, net.out_bias = others[b:-1], float(others[-1])
    return net


def calibrate(check: DataFrame, net: Network) -> None:
    """Set scale, shift and thresholds by all texts of `check`."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-13)), F.lit(1 - 1e-13))
    place = F.round(F.log(p / (1 - p)) * FINENESS).cast("int")
    counts = score(check, net).groupBy("lang", "label", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "calibration")
    # At most two rows for each step of the logit, and as many for each language with enough toxic texts.
    total = counts.groupBy("label", "place").agg(F.sum("n").alias("n")).toPandas()
    x, y, weight = logit_counts(total)
    net.thresholds = {None: UNSURE}
    if len(set(y)) < 2:
        return
    net.scale, net.shift = platt(x, y, weight)
    if weight[y == 1].sum() >= CALIBRATING:
        net.thresholds = {None: best_threshold(sigmoid(net.scale * x + net.shift), y, weight)}
    enough = counts.where("label = 1 AND lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= CALIBRATING)
    for lang, own in counts.join(enough, "lang").toPandas().groupby("lang"):
        x, y, weight = logit_counts(own)
        net.thresholds[lang] = best_threshold(sigmoid(net.scale * x + net.shift), y, weight)


def logit_counts(counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(counts[c].to_numpy(dtype=np.float64) / d for c, d in (("place", FINENESS), ("label", 1), ("n", 1)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    lang_col: str = "lang", sample: dict[int, int] | None = None,
    characters: int = CHARACTERS,
) -> Network:
    """`docs`: rows with an id, a text and a language; `labels`: rows with an id and a 0/1 label (of
    several, the highest counts). `sample` and `characters` bound what training starts with on the driver."""
    teach = teaching_texts(docs, labels, id_col, text_col, label_col, lang_col)
    sizes = {r["label"]: r["count"] for r in teach.groupBy("label").count().collect()}
    if len(sizes) < 2:
        net = Network.fresh()
        net.out[:] = 0
        rate = float(1 in sizes)
        net.out_bias = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
        net.thresholds = {None: 2.0}
        return net
    learn = teach.where("NOT apart")
    net = sweep(learn, start(learn, sizes, sample or SAMPLE, characters))
    calibrate(teach.where("apart"), net)
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Adds `score`, and with a language column `threshold` and `rejected`; they replace such columns."""
    docs = docs.drop("score", "threshold", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(net.plain())
    name = uuid.uuid4().hex  # this network, to workers

    def scorer() -> tuple[Network, RowTable]:
        model = Network(**shared.value)
        return model, RowTable(lambda new: model.embeddings[features(new)].sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vectors = of_worker(("toxicity", name), scorer)
        for batch in batches:
            found = [np.zeros(0)]
            for words, counts in portions(batch.column(text_col), split):
                rows = vectors.rows(words)
                of = vectors.values[rows] if len(rows) else np.zeros((0, DIMENSIONS), np.float32)
                found.append(sigmoid(model.scale * logits(of, counts, model) + model.shift))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found), type=pa.float64())], names=[*batch.schema.names, "score"]
            )

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    if lang_col is None:
        return scored
    threshold = F.lit(net.thresholds[None])
    for lang, cut in sorted((k, v) for k, v in net.thresholds.items() if k is not None):
        threshold = F.when(F.col(lang_col) == lang, F.lit(cut)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("rejected", F.col("score") >= F.col("threshold"))
