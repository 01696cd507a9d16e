"""Benchmark decontamination (operator 11): one Aho-Corasick automaton over the windows of all test items.

Test texts and documents are normalised alike: ASCII letters in lower case, every other ASCII character but
the digits a separator, one space between words. A window is `WINDOW` consecutive words of an item, or the
whole item if it has fewer. Each document is normalised and scanned once; matches begin and end at word
borders, and the word numbers lead back to code-point offsets of the original text.

The automaton works on bytes, so normalising keeps every byte in its place and any UTF-8 is allowed. Its
patterns, distinct pairs of window and item, are counted in Spark first: those over `MAX_PATTERN_BYTES` are
dealt by hash into as many automata as needed, and the documents are scanned by one after the other, with
equal results. Only one automaton's patterns are ever on the driver, in the broadcast or in a worker.

Null and empty texts have no words and no hits, and an item without a word has no windows. Very long texts
are held one at a time, with a few copies of their bytes. Items of the same id are one item, whatever their
rows; a null id counts as the empty one. Repeated documents are each marked. Empty tables give no rows or no hits.
Added columns (`n_words`, `n_hit`, `hit_words`, `hit_spans`, `items`) replace input columns of the same name.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import stored
from riskweave.llm.pieces import of_worker

WINDOW = 10
#: A pattern's byte becomes a node of about 60 bytes.
MAX_PATTERN_BYTES = 3 << 20

#: Byte -> itself, its lower case, or a space.
FLAT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACES = re.compile(rb" {2,}")

RANGE = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_words", RANGE),
    T.StructField("hit_spans", SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
]
ARROW_ADDED = [
    pa.int64(),
    pa.int64(),
    pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    pa.list_(pa.string()),
]


def normalised(flat: bytes) -> bytes:
    """The words, each with one space before and behind; a single space if there is none."""
    return SPACES.sub(b" ", b" " + flat + b" ")


def windows_of(text: bytes, size: int) -> set[bytes]:
    words = text.translate(FLAT).split(b" ")
    words = [w for w in words if w]
    starts = range(max(len(words) - size + 1, min(len(words), 1)))
    return {b" ".join(words[i : i + size]) for i in starts}


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(window binary, item string): the distinct pairs."""
    named = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                found = sorted(windows_of(bytes(text.as_py()), size))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [pa.array(part, pa.binary()), pa.array([item.as_py()] * len(part), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["window", "item"])

    return named.mapInArrow(run, "window binary, item string").distinct()


def automaton(patterns: Iterable[tuple[bytes, str]]) -> ahocorasick.Automaton:
    """Bytes stand for the characters of the same numbers. A pattern leads to its number of words and its items."""
    items_of = defaultdict(set)
    for window, item in patterns:
        items_of[window].add(item)
    built = ahocorasick.Automaton()
    for window, items in items_of.items():
        built.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, frozenset(items)))
    built.make_automaton()
    return built


def matches(line: bytes, built: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """First and last words of all windows that occur in a normalised text, and their items."""
    if not len(built):
        return [], set()
    found = list(built.iter(line.decode("latin-1")))
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    ranges = [(int(at) - size + 1, int(at)) for at, (size, _) in zip(last, (value for _, value in found), strict=True)]
    return ranges, set().union(*(items for _, (_, items) in found))


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjoining ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def spans(text: bytes, flat: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original (end exclusive) of ranges of words."""
    word = np.frombuffer(flat, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in ranges]


def _scan(docs: DataFrame, text_col: str, patterns: list[tuple[bytes, str]], keep_text: bool) -> DataFrame:
    """One pass over `docs`, which have the columns of `ADDED` from the pass before, or none of them."""
    again = ADDED[-1].name in docs.columns
    fields = docs.schema.fields if again else [*docs.schema.fields, *ADDED]
    schema = T.StructType([f for f in fields if keep_text or f.name != text_col])
    held = docs.sparkSession.sparkContext.broadcast(patterns)
    key = ("decontamination", uuid.uuid4().hex)
    names = [field.name for field in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = of_worker(key, lambda: automaton(held.value))
        for batch in batches:
            out: list[list] = [[] for _ in ADDED]
            texts = batch.column(text_col).cast(pa.binary())
            for at, text in enumerate(texts):
                text = text.as_py() or b""
                flat = text.translate(FLAT)
                line = normalised(flat)
                ranges, items = matches(line, built)
                if again:
                    ranges += [(r["first"], r["last"]) for r in batch.column("hit_words")[at].as_py()]
                    items |= set(batch.column("items")[at].as_py())
                ranges = merged(ranges)
                row = [
                    line.count(b" ") - 1,
                    sum(last - first + 1 for first, last in ranges),
                    [{"first": first, "last": last} for first, last in ranges],
                    [{"start": a, "end": b} for a, b in (spans(text, flat, ranges) if ranges else ())],
                    sorted(items),
                ]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kept = {n: batch.column(n) for n in batch.schema.names if n not in names}
            kept |= {n: pa.array(v, t) for n, v, t in zip(names, out, ARROW_ADDED, strict=True)}
            yield pa.RecordBatch.from_arrays([kept[n] for n in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_pattern_bytes: int = MAX_PATTERN_BYTES,
    keep_text: bool = True,
) -> DataFrame:
    """`docs` (without the text, if it need not come back from the tasks) with `n_words`, `n_hit` (words inside an occurrence of a window), `hit_words` (their ranges of
    word numbers, from 0), `hit_spans` (the same as offsets of the original) and `items` (sorted ids)."""
    docs = docs.drop(*(field.name for field in ADDED if field.name != text_col))
    pairs = stored(windows(items, item_id, item_text, window), "windows")
    total = pairs.agg(F.sum(F.length("window") + F.octet_length("item"))).first()[0] or 0
    parts = 1 + total // max_pattern_bytes
    # The item is hashed too: a window of very many items is dealt out as well.
    part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
    for number in range(parts):
        patterns = [(bytes(row[0]), row[1]) for row in pairs.where(part == number).select("window", "item").collect()]
        docs = _scan(docs, text_col, patterns, keep_text or number < parts - 1)
        if number < parts - 1:
            docs = stored(docs, "scanned")
    return docs
