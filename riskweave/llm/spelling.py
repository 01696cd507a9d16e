"""Spelling variants (operator 12): near words by permuterm rotations, and the chain to the usual form.

A word is marked with a terminator and turned in all ways. Two words that differ by one replaced character
have rotations that agree up to that character, placed last. A word and the same word without a character:
the turned shorter word equals the turned longer one but for its last character. So every rotation is
sorted twice, as a prefix without its last character and as a whole; equal keys form a group, which is read
once, in order, and gives each of its words its neighbours' number and the most frequent of them.

A group has at most one word for each letter of the alphabet and one shorter word, so groups are bounded
and no key is hot; pairs are never made, only counted. In a run of equal letters only the first counts as the
one left out, so that two words meet once.

Words are counted per task before they are shuffled. A form is at least twice as frequent as its variant, so
chains have at most 62 links; roots are found by doubling links, in at most six joins.

Null and empty texts have no words; very long texts are cut into portions between words. A null id counts as
the empty text. Ties of frequency go to the smaller word in code-point order. Repeated rows count as often as
they occur. Empty tables give no rows. Input columns but the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
RUN = re.compile(f"[{LETTERS}]+")
BREAK = re.compile(f"[^{LETTERS}]")
#: Follows no word: marks where a word ends.
TERMINATOR = "$"
#: Characters of a text taken at a time, and words a task counts before it hands them on.
PORTION = 1 << 20
COUNTED = 200_000

MIN_LETTERS = 5
MIN_OCCURRENCES = 3
#: One run in so many loses a letter (a rule of the test, off by default).
ONE_IN = 97


def portions(text: str) -> Iterator[str]:
    """`text` in parts of about `PORTION` characters, none cut inside a word."""
    at = 0
    while len(text) - at > PORTION:
        cut = BREAK.search(text, at + PORTION)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def with_typos(counts: Counter, doc_id: str, one_in: int) -> Counter:
    """The words of a document after the rule that leaves a letter out of one word in `one_in`: by the crc32
    of `doc_id:word`, which also tells the letter."""
    out = Counter()
    seed = zlib.crc32(f"{doc_id}:".encode())
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), seed)
        if h % one_in == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_one_in: int = 0) -> DataFrame:
    """(word, n): all distinct words of at least `MIN_LETTERS` letters and their occurrences."""
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def batch_of(counts: Counter) -> pa.RecordBatch:
        words = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(words, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                # bytes.lower() changes A-Z only.
                text = text.as_py().lower().decode(errors="replace")
                own: Counter = Counter()
                for portion in portions(text):
                    own.update(RUN.findall(portion))
                if typo_one_in:
                    own = with_typos(own, doc_id.as_py(), typo_one_in)
                for word, n in own.items():
                    if len(word) >= MIN_LETTERS:
                        counted[word] += n
                if len(counted) > COUNTED:
                    yield batch_of(counted)
                    counted = Counter()
        if counted:
            yield batch_of(counted)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, last, first_of_run, word, n): each rotation without its last character (`last`), and each
    whole (`last` null). The one that ends in the terminator is needed only whole."""
    size = F.length("word")
    place = F.explode(F.sequence(F.lit(0), size))
    turned = words.select("word", "n", place.alias("i"))
    before, behind = F.expr("substring(word, 1, i)"), F.expr("substring(word, i + 1)")
    letter, rest = F.expr("substring(word, i + 1, 1)"), F.expr("substring(word, i + 2)")
    left_out = F.struct(
        F.concat(rest, F.lit(TERMINATOR), before).alias("key"),
        letter.alias("last"),
        ((F.col("i") == 0) | (F.expr("substring(word, i, 1)") != letter)).alias("first_of_run"),
    )
    whole = F.struct(
        F.concat(behind, F.lit(TERMINATOR), before).alias("key"),
        F.lit(None).cast("string").alias("last"),
        F.lit(False).alias("first_of_run"),
    )
    both = F.when(F.col("i") < F.length("word"), F.array(left_out, whole)).otherwise(F.array(whole))
    return turned.select("word", "n", F.inline(both))


def neighbours(group: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the most frequent of them, that word) for the rows (last, first_of_run, word,
    n) of one key; words without a near word are left out. Linear but for one sort."""
    shorter = [(n, word) for last, _, word, n in group if last is None]
    longer = sorted((-n, word, first) for last, first, word, n in group if last is not None)
    for minus_n, word, first in longer:
        others = [(-c[0], c[1]) for c in longer[:2] if c[1] != word][:1]
        if first:
            others += shorter
        if others:
            n, best = min(others, key=lambda c: (-c[0], c[1]))
            yield word, len(longer) - 1 + (len(shorter) if first else 0), n, best
    losers = [(-minus_n, word) for minus_n, word, first in longer if first]
    if losers:
        for _, word in shorter:
            yield word, len(losers), *losers[0]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): the words with a near word, of stored `words` (word, n)."""
    rows = rotations(words)
    ordered = rows.repartitionByRange(F.col("key")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in ("last", "first_of_run", "word", "n")]
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            found: list[tuple] = []
            # The first and last groups may go on beyond the batch; of the others only those of two or more rows count.
            last = len(starts) - 1
            wanted = np.flatnonzero(ends - starts > 1)
            for g in sorted({0, last, *wanted.tolist()}):
                a, b = int(starts[g]), int(ends[g])
                group = list(zip(*(c.slice(a, b - a).to_pylist() for c in columns), strict=True))
                if g == 0 and keys[0] == held_key:
                    group = held + group
                elif g == 0 and held:
                    found += neighbours(held)
                if g == last:
                    held, held_key = group, keys[-1]
                else:
                    found += neighbours(group)
            yield emitted(found)
        yield emitted(list(neighbours(held)))

    def emitted(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n", "near_word"])

    met = ordered.mapInArrow(run, "word string, near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near_word"))
    return (
        met.groupBy("word")
        .agg(F.sum("near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.near_word").alias("best"))
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for stored `links` (word, form) without cycles: forms followed to the last."""
    links = links.select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(onward, "root", "left")
        longer = stored(
            joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        links = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(counts: DataFrame, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    """(word, n, form, form_n, root, n_near) for all words of `counts` (word, n) frequent enough."""
    words = stored(counts.where(F.col("n") >= min_occurrences), "words")
    usual = F.col("best_n") >= 2 * F.col("n")
    linked = stored(
        words.join(near_words(words), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(usual, F.col("best")).alias("form"),
            F.when(usual, F.col("best_n")).alias("form_n"),
        ),
        "linked",
    )
    found = roots(stored(linked.where("form IS NOT NULL").select("word", "form"), "links"))
    return linked.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
