"""Language identification (operator 7) by unigrams with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, found by the forward algorithm; that of a text is the
product over its words. The piece probabilities are fitted by expectation-maximisation: every round,
Spark tasks run forward and backward over the word counts of the sample and return expected counts of
the pieces. The prediction is the most likely language, its score the posterior with equal priors.

The posterior says which learned language is nearest, not whether the text is in one: some language wins
any text. For that, `predict` can add the log-probability per character in the language it chose, and
`ordinary` compares it with the other texts of that language.

Words are parted by white space, lowered, freed from signs at their ends (a word of signs alone keeps
them; signs at the ends of others are not scored), and begin with the vocabulary's word mark. Words of
any length are read whole, in logarithms. A character without a piece counts as the unknown piece.

Fitted on about `SAMPLE` distinct texts per language (all, if there are fewer), chosen by a hash of the
text among the rows given. Rows with a null or empty text, or a null language, teach nothing. A text that
is null or has no letter is `und` with score 1; if there is no language to learn, every text is `und`.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import stored
from riskweave.llm.pieces import of_worker
from riskweave.llm.rows import RowTable, portions, summed

UNDETERMINED = "und"
SAMPLE = 1500
ROUNDS = 4
#: Places (characters of all words) that a block of words holds; a longer word is a block of its own.
PLACES = 1 << 18
#: Words of a block, and starts whose pieces are looked up together.
BLOCK, STARTS = 8192, 4096
SMOOTHING, FLOOR = 0.01, 1e-9
#: How far below the lower quartile of its language a text's log-probability per character may be: so many
#: distances of the quartiles, but at least `SLACK`, as long texts of one kind lie close together.
FENCES, SLACK = 3.0, 1.5
MARK = "▁"
EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_"
LETTER = regex.compile(r"\p{L}")


def word_form(word: str) -> str:
    """Lower case, without signs at either end; a word of signs stays as it is."""
    return word.strip(EDGE).lower() or word


class Pieces:
    """The vocabulary's ordinary pieces, numbered; the unknown piece is the last number."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        usual = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.numbers = {sp.id_to_piece(i): n for n, i in enumerate(usual)}
        self.unknown = len(self.numbers)
        self.longest = max(map(len, self.numbers))
        # A trie: state 0 is the beginning, every other state a beginning of a piece.
        begun = {p[:k] for p in self.numbers for k in range(1, len(p) + 1)}
        states = {"": 0} | {b: n for n, b in enumerate(sorted(begun), 1)}
        #: The piece that each state is, or -1.
        self.piece = np.array([self.numbers.get(b, -1) for b in states], dtype=np.int64)
        #: Characters numbered from 1; 0 is in no piece.
        self.character = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        letters = sorted({ord(c) for b in begun for c in b})
        self.character[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        steps = [(states[b[:-1]] * self.width + int(self.character[ord(b[-1])]), n) for b, n in states.items() if b]
        #: Codes of (state, character), sorted, and the states they lead to; the last code is never met.
        self.codes, self.leads_to = np.array([*sorted(steps), (np.iinfo(np.int64).max, 0)], dtype=np.int64).T.copy()

    def step(self, states: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The states after one more character; 0 where no piece goes on so."""
        code = states * self.width + characters
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.leads_to[at], 0)

    def edges(self, words: list[str], first: int, last: int) -> np.ndarray:
        """Rows (word, start, end, piece) of every piece that starts at the places from `first` to before
        `last`, by start; of one word and start, each end occurs once."""
        near = [word[first : last - 1 + self.longest] for word in words]
        sizes = np.array([len(word) for word in near], dtype=np.int64)
        text = self.character[np.frombuffer("".join(near).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        who, through = np.repeat(np.arange(len(near)), sizes), np.repeat(np.cumsum(sizes), sizes)
        start = np.arange(len(text)) - (through - sizes[who])
        # All starts go on together, a character at a time.
        at = np.flatnonzero(start < last - first)
        state = self.step(np.zeros(len(at), dtype=np.int64), text[at])
        piece = self.piece[state]
        found = [(at, 1, np.where(piece < 0, self.unknown, piece))]
        for length in range(2, self.longest + 1):
            on = np.flatnonzero((state > 0) & (at + length <= through[at]))
            at = at[on]
            state = self.step(state[on], text[at + length - 1])
            piece = self.piece[state]
            found.append((at[piece >= 0], length, piece[piece >= 0]))
        # One number per edge: start, word, length, piece.
        codes = np.sort(np.concatenate([start[at] << 48 | who[at] << 32 | length << 16 | piece for at, length, piece in found]))
        start = (codes >> 48) + first
        return np.stack([codes >> 32 & 0xFFFF, start, start + (codes >> 16 & 0xFFFF), codes & 0xFFFF], axis=1)

    def lattice(self, words: list[str]) -> Iterator[np.ndarray]:
        """Edges of the words, portion by portion, by start."""
        for first in range(0, max(map(len, words)), STARTS):
            yield self.edges(words, first, first + STARTS)


def marked(word: str) -> str:
    return MARK + word_form(word)


def blocks(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words, in blocks of like lengths."""
    own: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if own and (len(own) >= BLOCK or (len(own) + 1) * len(words[i]) > PLACES):
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def by_start(edges: np.ndarray) -> list[slice]:
    if not len(edges):
        return []
    cut = np.flatnonzero(np.diff(edges[:, 1])) + 1
    return [slice(a, b) for a, b in zip([0, *cut], [*cut, len(edges)], strict=True)]


def nothing_yet(words: list[str], *more: int) -> np.ndarray:
    """[word, place, ...]: log 0."""
    return np.full((len(words), max(map(len, words)) + 1, *more), -np.inf)


def forward(alpha: np.ndarray, edges: np.ndarray, log_p: np.ndarray) -> None:
    """Carries alpha over the edges: alpha[word, place, ...] is the logarithm of the summed probability of
    all segmentations up to the place. `log_p` has a row for each edge."""
    for part in by_start(edges):
        who, start, end = edges[part, 0], edges[part.start, 1], edges[part, 2]
        alpha[who, end] = np.logaddexp(alpha[who, end], alpha[who, start] + log_p[part])


def backward(beta: np.ndarray, edges: np.ndarray, log_p: np.ndarray) -> None:
    """Likewise from the ends of the words to their beginnings."""
    for part in reversed(by_start(edges)):
        who, start, end = edges[part, 0], edges[part.start, 1], edges[part, 2]
        np.logaddexp.at(beta[:, start], who, beta[who, end] + log_p[part])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    probabilities: np.ndarray  # [piece, language]
    pieces_path: str


def learning_words(docs: DataFrame, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, word, n) over the sample, stored."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    # One number per language.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = [x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30))))]
    if not share:
        share = [F.lit(""), F.lit(0)]
    chosen = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.element_at(F.create_map(*share), F.col("lang")))
    once = chosen.groupBy("lang", "h").agg(F.first("text").alias("text"))
    words = once.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''")
    return stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")


def fit(
    docs: DataFrame, pieces_path: str, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS
) -> LanguageModel:
    words = learning_words(docs, text_col, lang_col, sample)
    languages = tuple(sorted(r["lang"] for r in words.select("lang").distinct().collect()))
    numbers = {lang: i for i, lang in enumerate(languages)}
    width = Pieces(pieces_path).unknown + 1
    p = np.full((width, max(1, len(languages))), 1.0 / width)
    context = docs.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast(p)  # pieces of one vocabulary times languages

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, p = Pieces(pieces_path), shared.value
            counts = np.zeros(p.size)
            logs = np.log(p)
            for batch in batches:
                words = [marked(w) for w in batch.column("word").to_pylist()]
                lang = np.array([numbers[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
                n = batch.column("n").to_numpy(zero_copy_only=False)
                for block in blocks(words):
                    own = [words[i] for i in block]
                    alpha, beta = nothing_yet(own), nothing_yet(own)
                    ends = np.arange(len(own)), np.array([len(w) for w in own])
                    alpha[:, 0], beta[ends] = 0, 0
                    lattice = [(e, lang[block][e[:, 0]]) for e in pieces.lattice(own)]
                    for edges, of in lattice:
                        forward(alpha, edges, logs[edges[:, 3], of])
                    for edges, of in reversed(lattice):
                        backward(beta, edges, logs[edges[:, 3], of])
                    whole = alpha[ends]
                    for edges, of in lattice:
                        who, start, end, piece = edges.T
                        use = alpha[who, start] + logs[piece, of] + beta[who, end] - whole[who]
                        weight = n[block][who] * np.exp(use)
                        counts += np.bincount(piece * p.shape[1] + of, weights=weight, minlength=p.size)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["cell", "n"])

        # One row per used piece and language.
        sums = words.mapInArrow(expected, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(p.size)
        counts[sums["cell"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy()
        counts = counts.reshape(p.shape) + SMOOTHING
        p = np.maximum(counts / counts.sum(axis=0), FLOOR)
    return LanguageModel(languages, p, pieces_path)


class Scorer:
    """Of each word: its log-probability in every language, then its length with the word mark."""

    def __init__(self, model: dict):
        self.pieces, self.logs = Pieces(model["path"]), np.log(model["p"])
        self.forms = RowTable(self.form_rows)
        self.table = RowTable(self.word_rows)

    def word_rows(self, words: list[str]) -> np.ndarray:
        rows = self.forms.rows([word_form(w) for w in words])
        return self.forms.values[rows]

    def form_rows(self, forms: list[str]) -> np.ndarray:
        languages = self.logs.shape[1]
        out = np.zeros((len(forms), languages + 1))
        words = [MARK + form for form in forms]
        for block in blocks(words):
            own = [words[i] for i in block]
            alpha = nothing_yet(own, languages)
            alpha[:, 0] = 0
            for edges in self.pieces.lattice(own):
                forward(alpha, edges, self.logs[edges[:, 3]])
            lengths = np.array([len(w) for w in own])
            out[block, :languages] = alpha[np.arange(len(own)), lengths]
            out[block, languages] = lengths
        return out


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", rate_col: str | None = None) -> DataFrame:
    """Adds `lang_pred` and `score` to the documents, and under `rate_col` the log-probability per character
    (a word mark counts as one) in that language, null for `und`; they replace columns of these names."""
    docs = docs.drop("lang_pred", "score", *([rate_col] if rate_col else []))
    shared = docs.sparkSession.sparkContext.broadcast({"path": model.pieces_path, "p": model.probabilities})
    languages, name = model.languages, uuid.uuid4().hex  # this model, to workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = of_worker(("language", name), lambda: Scorer(shared.value)) if languages else None
        for batch in batches:
            texts = batch.column(text_col)
            logs = [np.zeros((0, len(languages) + 1))]
            if scorer:
                for words, counts in portions(texts, str.split):
                    rows = scorer.table.rows(words)
                    logs.append(summed(scorer.table.values[rows], counts))
            found = np.concatenate(logs)
            named, scores, rates = [], [], []
            for i, text in enumerate(texts):
                if not scorer or not LETTER.search(text.as_py() or ""):
                    named.append(UNDETERMINED)
                    scores.append(1.0)
                    rates.append(None)
                else:
                    of = found[i, :-1]
                    best = int(of.argmax())
                    named.append(languages[best])
                    scores.append(float(1.0 / np.exp(of - of[best]).sum()))
                    rates.append(float(of[best] / found[i, -1]))
            added = [pa.array(named, type=pa.string()), pa.array(scores, type=pa.float64())]
            if rate_col:
                added.append(pa.array(rates, type=pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    names = ["lang_pred", "score", *([rate_col] if rate_col else [])]
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    added = [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=False)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def ordinary(predicted: DataFrame, rate_col: str, flag_col: str, fences: float = FENCES) -> DataFrame:
    """Adds `flag_col`: whether the text's log-probability per character is not far below that of the texts
    with the same `lang_pred`: below the lower quartile by at most `fences` times the distance of the
    quartiles, or `SLACK` if that is more. Quartiles are over all texts given, equal values once. `und` is
    never ordinary. No rows give no rows."""
    once = predicted.where(F.col(rate_col).isNotNull()).select("lang_pred", rate_col).distinct()
    # One row per learned language.
    quartiles = once.groupBy("lang_pred").agg(F.percentile_approx(rate_col, [0.25, 0.75], 10_000).alias("q")).collect()
    low = F.lit(None).cast("double")
    for r in quartiles:
        low = F.when(F.col("lang_pred") == r["lang_pred"], r["q"][0] - max(SLACK, fences * (r["q"][1] - r["q"][0]))).otherwise(low)
    return predicted.withColumn(flag_col, F.coalesce(F.col(rate_col) >= low, F.lit(False)))
