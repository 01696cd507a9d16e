"""Language-model scoring (operator 4) with a log-bilinear model trained by noise-contrastive estimation.

Every token has two vectors: as context and as target. The score of a target after a context is their
dot product plus the target's bias; the sum of each context over all targets turns scores into normalised
log-probabilities.

* All training text is counted in Spark: tokens, and pairs of neighbours. Nothing is sampled from it;
  what the counts hold grows with the corpus.
* The frequent words are tokens of the model: about as many as the square root of the number of training
  tokens, at least `WORDS`, so the vocabulary grows with the corpus and the work of a step in proportion to
  it. All others fall into `CLASSES` classes by the hash of their last two bytes; a class is a token too, and gives its words the share
  (c + 1) / (N + V + 1) of its counts, with one share left for unseen words. So every word has a
  probability, and the model stays normalised.
* The pair counts are a sparse matrix of the model's tokens, stored in blocks of contexts, as the bytes of two
  arrays each. Each step trains on all of it in Spark tasks, a block at a time, and the gradients of the tasks
  are added up in Spark; the driver gets one gradient a step and holds the vectors only.
* Texts are split, and their words looked up, in columns; no word of them is an object of its own.
* Scoring holds the counts of at most `KNOWN` frequent words in each worker; counts of the rarer words
  of a text are joined in Spark.

Tokens are runs without ASCII white space, A-Z lowered, and one end per document; a document begins
after an end. A null text is empty: its only token is the end. Repeated rows are counted and scored
each. Without training rows the model knows nothing and gives all its tokens equal probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import stored
from riskweave.llm.rows import summed

WORDS, CLASSES, KNOWN = 2048, 61, 100_000
DIMENSIONS, STEPS, NOISE_WEIGHT, RATE = 32, 80, 25.0, 0.05
#: Strength of the normal prior of the vectors, in tokens: it holds a small corpus near its unigrams.
PRIOR = 5.0
#: No word has white space in it, so the end is a "word" of its own.
END = b"\n"
#: Bytes of text whose words are taken at a time, about, and pairs whose vectors are.
PORTION, PAIRS = 1 << 22, 1 << 15
#: Words, distinct in their portions, or pairs that a task gathers before it hands them on.
GATHERED = 2_400_000
#: Scores of a block: its contexts times all targets.
CELLS = 1 << 19
#: Tasks of a step at most: each sums a gradient of the targets.
STEP_TASKS = 32
#: Targets whose gradients are a row, when those of the tasks are added up, and bytes that the driver gets
#: from one task, about.
TARGETS, SENT = 1024, 1 << 19
STEP_BITS = 8  # buckets per doubling when a count threshold is searched


def split(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, number of words of each text) for bounded portions of the texts; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PORTION, "right")))
        portion = pc.ascii_lower(pc.fill_null(texts.slice(at, to - at), ""))
        at = to
        lists = pc.ascii_split_whitespace(portion)
        words = lists.flatten()
        full = pc.greater(pc.binary_length(words), 0)  # around white space at the ends of a text are empty ones
        number = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        yield words.filter(full).cast(pa.binary()), np.diff(number[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def word_class(word: bytes) -> int:
    return crc32(word[-2:]) % CLASSES


#: Classes by the last two bytes as a number; from 65,536 on, those of words of one byte.
CLASS_TABLE = np.array(
    [word_class(bytes([first, last])) for first in range(256) for last in range(256)]
    + [word_class(bytes([last])) for last in range(256)],
    dtype=np.uint8,
)


def word_classes(words: pa.Array) -> np.ndarray:
    """The class of each word; no word is empty."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, dtype=np.uint8)
    last, length = data[offsets[1:] - 1].astype(np.int64), np.diff(offsets)
    first = data[np.maximum(offsets[1:] - 2, 0)].astype(np.int64)
    return CLASS_TABLE[np.where(length > 1, 256 * first, 65_536) + last].astype(np.int64)


def numbers_in(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word in `known`, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the column `text`, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, texts = [], 0, 0
        for batch in batches:
            for words, counts in split(batch.column("text")):
                found = words.value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                n += len(found)
                texts += len(counts)
                if n > GATHERED:
                    yield from totals(held)
                    held, n = [], 0
        if held:
            yield from totals(held)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([texts])], names=["word", "n"])

    def totals(held):
        found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return found.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    partial = docs.select("text").mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def threshold(counts: DataFrame, most: int) -> int:
    """A count that at most `most` words reach, near the least such one."""
    bucket = F.floor(F.log2("n") * STEP_BITS)
    # A few hundred rows: buckets are logarithmic.
    rows = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low")).collect()
    total, low = 0, 1 << 62
    for row in sorted(rows, key=lambda r: -r["b"]):
        total += row["words"]
        if total > most:
            break
        low = row["low"]
    return low


@dataclass(frozen=True)
class Model:
    counts: DataFrame  # (word, n) of all training tokens, stored
    tokens: int
    distinct: int
    known_from: int  # words of this count or more are in `known`
    known: dict  # word -> (its model token, its count)
    class_size: np.ndarray  # N + V + 1 of each class
    context: np.ndarray  # vectors of all tokens
    target: np.ndarray
    bias: np.ndarray
    log_sum: np.ndarray  # of each context: the log of the sum of its scores' exponentials

    @property
    def end(self) -> int:
        return len(self.bias) - 1

    @property
    def log10(self) -> np.ndarray:
        """[context, target], as a whole: for small models."""
        return (self.context @ self.target.T + self.bias - self.log_sum[:, None]) / np.log(10)


def class_sizes(counts: DataFrame, vocabulary_from: int) -> np.ndarray:
    rare = counts.where((F.col("n") < vocabulary_from) & (F.col("word") != F.lit(END)))
    last = F.expr("substring(word, -2)")
    rows = rare.groupBy((F.crc32(last) % CLASSES).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    sizes = np.ones(CLASSES)
    for row in rows:
        sizes[row["class"]] += row["n"] + row["v"]
    return sizes


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids of all texts in a row, each followed by an end."""
    out = np.full(len(ids) + len(counts), end, dtype=np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def pairs_of(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of all texts: neighbours, with the end around each text."""
    targets = with_ends(ids, counts, end)
    return np.concatenate([[end], targets[:-1]]), targets


# Training

#: Pair counts of a block: flat places [context, target] in its scores, and their counts, as bytes of int32 and int64.
COUNTED = "block long, at binary, n binary"


def block_count(size: int) -> int:
    """Blocks of contexts, each with about `CELLS` scores. Block b has the contexts b, b + blocks, ..."""
    return -(-size // max(1, CELLS // size))


def cells(size: int) -> int:
    """Scores of the largest block."""
    return -(-size // block_count(size)) * size


def by_block(contexts: np.ndarray, targets: np.ndarray, size: int, n: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows `COUNTED` of pairs that may repeat, each with its count in `n`, by default 1."""
    blocks, each = block_count(size), cells(size)
    codes = contexts % blocks * each + contexts // blocks * size + targets
    if n is None:
        codes, n = np.unique(codes, return_counts=True)
    else:
        codes, same = np.unique(codes, return_inverse=True)
        total = np.zeros(len(codes), dtype=np.int64)
        np.add.at(total, same, n)
        n = total
    names, starts = np.unique(codes // each, return_index=True)
    places = np.split((codes % each).astype(np.int32), starts[1:]) if len(names) else []
    counts = np.split(n.astype(np.int64), starts[1:]) if len(names) else []
    columns = [pa.array(names, type=pa.int64()), *(pa.array([x.tobytes() for x in c], type=pa.binary()) for c in (places, counts))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "at", "n"])


def places_and_counts(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    at, n = (batch.column(c)[row].as_buffer() for c in ("at", "n"))
    return np.frombuffer(at, dtype=np.int32), np.frombuffer(n, dtype=np.int64)


def text_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The counts of neighbours in the column `text`, with the end around each, one row per block."""
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))
    size = len(vocabulary) + CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, type=pa.binary())
        held, n = [], 0
        for batch in batches:
            for words, counts in split(batch.column("text")):
                ids = numbers_in(words, known)
                rare = ids < 0
                ids[rare] = len(known) + word_classes(words.filter(pa.array(rare)))
                held.append(pairs_of(ids, counts, size - 1))
                n += len(held[-1][0])
                if n > GATHERED:
                    yield by_block(*map(np.concatenate, zip(*held)), size)
                    held, n = [], 0
        if held:
            yield by_block(*map(np.concatenate, zip(*held)), size)

    return added_blocks(docs.select("text").mapInArrow(run, COUNTED), size)


def pair_blocks(pairs: DataFrame, size: int) -> DataFrame:
    """The counts of rows (pair, n), where pair is context * size + target, one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
            yield by_block(pair // size, pair % size, size, n)

    return added_blocks(pairs.select("pair", "n").mapInArrow(run, COUNTED), size)


def added_blocks(parts: DataFrame, size: int) -> DataFrame:
    """Rows `COUNTED`, any number of each block -> their sum, one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(cells(size), dtype=np.int64)
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block != now:
                    if now is not None:
                        yield row(now, total)
                    now = block
                    total[:] = 0
                at, n = places_and_counts(batch, i)
                total[at] += n  # the places of a row differ
        if now is not None:
            yield row(now, total)

    def row(block, total):
        at = np.flatnonzero(total)
        columns = [[block], [at.astype(np.int32).tobytes()], [total[at].tobytes()]]
        types = pa.int64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["block", "at", "n"])

    return parts.repartition(block_count(size), "block").sortWithinPartitions("block").mapInArrow(run, COUNTED)


def train(blocks: DataFrame, unigram: np.ndarray, tokens: int, steps: int = STEPS, seed: int = 5) -> list[np.ndarray]:
    """Noise-contrastive estimation over all pairs in each step: vectors as context, as target, and the bias.

    Data pairs are told from noise, targets drawn from `unigram`, of which there are NOISE_WEIGHT for each
    data pair. The expectation over the noise is summed exactly instead of drawn: that is one more matrix
    product, and the steps have no sampling error.
    """
    rng = np.random.default_rng(seed)
    size = len(unigram)
    tokens = max(float(tokens), 1.0)
    small = [rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) for _ in range(2)]
    values = [*small, np.log(unigram).astype(np.float32)]
    mean, square = ([np.zeros_like(v) for v in values] for _ in range(2))
    for step in range(1, steps + 1):
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        shrink = PRIOR / tokens
        gradients = summed_gradients(blocks, values, unigram, tokens)
        gradients[0] += shrink * values[0]
        gradients[1] += shrink * values[1]
        for i, gradient in enumerate(gradients):
            mean[i] = 0.9 * mean[i] + 0.1 * gradient
            square[i] = 0.99 * square[i] + 0.01 * gradient**2
            move = (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-10)
            values[i] = values[i] - (rate * move).astype(np.float32)
    return values


def summed_gradients(blocks: DataFrame, values: list[np.ndarray], unigram: np.ndarray, tokens: float) -> list[np.ndarray]:
    """Gradients of (context, target, bias) over all blocks; a task sums those of its blocks, and the sums of
    the tasks are added up portion by portion, in the order of the tasks."""
    size = len(unigram)
    apart = block_count(size)
    shared = blocks.sparkSession.sparkContext.broadcast((values, unigram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (context, target, bias), unigram = shared.value
        of_target, of_bias = np.zeros_like(target), np.zeros_like(bias)
        names, parts = [], []
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                at, n = places_and_counts(batch, i)
                own = context[block::apart]
                slope = block_slope(own, target, bias, unigram, at, n / tokens)
                names.append(block)
                parts.append((slope @ target).tobytes())
                of_target += slope.T @ own
                of_bias += slope.sum(axis=0)
        if names:
            both = np.column_stack([of_target, of_bias])
            for at in range(0, size, TARGETS):
                names.append(-1 - at)
                parts.append(both[at : at + TARGETS].tobytes())
            source = pa.array([TaskContext.get().partitionId()] * len(names), type=pa.int32())
            columns = [pa.array(names, type=pa.int64()), source, pa.array(parts, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "source", "gradient"])

    # Of the targets a gradient from each of a few tasks, of the contexts one from all together.
    tasks = min(blocks.sparkSession.sparkContext.defaultParallelism, STEP_TASKS)
    parts = blocks.coalesce(tasks).mapInArrow(run, "part long, source int, gradient binary")
    sent = -(-sum(v.nbytes for v in values) // SENT)
    sums = parts.repartition(sent, "part").sortWithinPartitions("part", "source").mapInArrow(added_up, "part long, gradient binary")
    out = [np.zeros_like(v) for v in values]
    for batch in sums.toArrow().to_batches():
        for part, gradient in zip(batch.column("part").to_pylist(), batch.column("gradient")):
            gradient = np.frombuffer(gradient.as_buffer(), dtype=np.float32)
            if part >= 0:
                out[0][part::apart] = gradient.reshape(-1, DIMENSIONS)
            else:
                both = gradient.reshape(-1, DIMENSIONS + 1)
                at = slice(-1 - part, -1 - part + len(both))
                out[1][at], out[2][at] = both[:, :-1], both[:, -1]
    shared.destroy()
    return out


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, source, gradient) by part -> the sum of each part."""

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()])], names=["part", "gradient"])

    now = total = None
    for batch in batches:
        for part, gradient in zip(batch.column("part").to_pylist(), batch.column("gradient")):
            gradient = np.frombuffer(gradient.as_buffer(), dtype=np.float32)
            if part == now:
                total += gradient
                continue
            if now is not None:
                yield row()
            now, total = part, gradient.copy()
    if now is not None:
        yield row()


def block_slope(context, target, bias, unigram: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Slopes of the scores [context, target]; `data` are the shares of the pairs at the flat places `at`."""
    expected = NOISE_WEIGHT * unigram
    slope = context @ target.T
    slope += (bias - np.log(expected)).astype(np.float32)
    sigmoid_in_place(slope)  # the probability that a pair is data
    flat = slope.reshape(-1)
    missed = (flat[at] - 1) * data.astype(np.float32)
    slope *= np.bincount(at // len(bias), weights=data, minlength=len(context)).astype(np.float32)[:, None]
    slope *= expected.astype(np.float32)
    flat[at] += missed
    return slope


def sigmoid_in_place(x: np.ndarray) -> None:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def log_sums(spark: SparkSession, values: list[np.ndarray]) -> np.ndarray:
    """Of each context the log of the sum of its scores' exponentials over all targets."""
    size = len(values[2])
    shared = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, target, bias = shared.value
        each = max(1, CELLS // size)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at in range(0, len(ids), each):
                part = ids[at : at + each]
                scores = (context[part] @ target.T + bias).astype(np.float64)
                most = scores.max(axis=1)
                sums = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums)], names=["id", "log_sum"])

    out = np.empty(size)
    # A number for each context.
    tasks = min(spark.sparkContext.defaultParallelism, block_count(size))
    found = spark.range(0, size, 1, tasks).mapInArrow(run, "id long, log_sum double").toArrow()
    out[found["id"].to_numpy()] = found["log_sum"].to_numpy()
    return out


def vocabulary_size(tokens: int) -> int:
    return max(WORDS, isqrt(tokens))


def fit(docs: DataFrame, text_col: str = "text", words: int | None = None, known: int = KNOWN, steps: int = STEPS) -> Model:
    """`words`: words of the vocabulary at most, by default as many as `vocabulary_size` gives."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = stored(token_counts(texts), "token-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words = words or vocabulary_size(tokens)
    known = max(known, words)
    plain = counts.where(F.col("word") != F.lit(END))
    vocabulary_from, known_from = threshold(plain, words), threshold(plain, known)
    top = plain.where(F.col("n") >= known_from).toArrow()  # at most `known` rows
    ranked = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    del top
    vocabulary = {word: i for i, (word, n) in enumerate(ranked) if n >= vocabulary_from}
    first_class = len(vocabulary)
    known_words = {word: (vocabulary.get(word, first_class + word_class(word)), n) for word, n in ranked}
    sizes = class_sizes(counts, vocabulary_from)
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights = [*(known_words[w][1] for w in vocabulary), *(sizes - 1), ends]
    unigram = (np.array(weights, dtype=np.float64) + 1) / (np.sum(weights) + len(weights))
    blocks = stored(text_blocks(texts, vocabulary), "pair-blocks")
    values = train(blocks, unigram, tokens, steps)
    sums = log_sums(docs.sparkSession, values)
    return Model(counts, int(tokens), int(distinct), int(known_from), known_words, sizes, *values, sums)


# Scoring


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: `doc_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score` (smoothed unigrams) and
    `score` (the model), both as log10 of the text's probability."""
    spark = docs.sparkSession
    names = list(model.known)
    shared = spark.sparkContext.broadcast(
        {
            "known": names,
            "token": np.array([model.known[w][0] for w in names], dtype=np.int64),
            "count": np.array([model.known[w][1] for w in names], dtype=np.float64),
            "class_size": model.class_size,
            "vectors": (model.context, model.target, model.bias, model.log_sum),
        }
    )
    ends = model.counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = PartScorer(shared.value, ends)
        for batch in batches:
            at = 0
            for words, counts in split(batch.column("text")):
                columns = [c.slice(at, len(counts)) for c in (batch.column("row"), batch.column("doc_id"))]
                at += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [*columns, *scorer.parts(words, counts)],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"],
                )

    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<binary>"
    parts = stored(read.mapInArrow(run, schema), "score-parts")
    # Words of lower counts than the workers hold. Unseen ones add log10(0 + 1) = 0: they need no row.
    rare_counts = model.counts.where(F.col("n") < model.known_from)
    rare = parts.select("row", F.explode("rare").alias("word")).join(rare_counts, "word")
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("sum"), F.count(F.lit(1)).alias("found"))
    joined = parts.drop("rare").join(sums, "row", "left")
    rest, found = F.coalesce("sum", F.lit(0.0)), F.coalesce("found", F.lit(0))
    divisor = float(np.log10(model.tokens + model.distinct + 1))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + found).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )


class PartScorer:
    """What a worker can add up of the scores of texts, and the words that it has no counts for."""

    def __init__(self, shared: dict, ends: int):
        self.known, self.token = pa.array(shared["known"], type=pa.binary()), shared["token"]
        self.context, self.target, self.bias, self.log_sum = shared["vectors"]
        self.of_count = np.log10(shared["count"] + 1)
        self.of_class = np.log10(shared["class_size"])
        self.end = len(self.bias) - 1
        self.first_class = self.end - CLASSES
        self.ends, self.of_end = ends, float(np.log10(ends + 1))

    def parts(self, words: pa.Array, counts: np.ndarray) -> list[pa.Array]:
        numbers = numbers_in(words, self.known)
        rare = numbers < 0
        unknown = words.filter(pa.array(rare))
        ids = np.empty(len(words), dtype=np.int64)
        base = np.zeros(len(words))
        ids[~rare] = self.token[numbers[~rare]]
        base[~rare] = self.of_count[numbers[~rare]]
        ids[rare] = self.first_class + word_classes(unknown)
        # The share of a word in its class: its count (the known ones here) over the class's size.
        classed = ids >= self.first_class
        inside = np.where(classed, base, 0.0)
        inside[classed] -= self.of_class[ids[classed] - self.first_class]
        contexts, targets = pairs_of(ids, counts, self.end)
        model = summed(self.of_pairs(contexts, targets), counts + 1) + summed(inside, counts)
        known = summed((~rare).astype(np.float64), counts) + (self.ends > 0)
        offsets = np.concatenate([[0], np.cumsum(summed(rare.astype(np.float64), counts))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), unknown)
        return [
            pa.array(counts + 1),
            pa.array(known.astype(np.int64)),
            pa.array(summed(base, counts) + self.of_end),
            pa.array(model),
            lists,
        ]

    def of_pairs(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 P(target | context) of each pair."""
        scores = np.empty(len(targets), dtype=np.float32)
        for at in range(0, len(targets), PAIRS):
            c, t = contexts[at : at + PAIRS], targets[at : at + PAIRS]
            np.einsum("ij,ij->i", self.context[c], self.target[t], out=scores[at : at + PAIRS])
        scores += self.bias[targets]
        return (scores - self.log_sum[contexts]) / np.log(10)
