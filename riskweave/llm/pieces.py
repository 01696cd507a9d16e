"""Encoding with the tokenizers library, each distinct piece of text once per worker.

Neither vocabulary merges across white space, so a text is cut at its spaces into pieces that encode
independently. The library's own normaliser, pre-tokeniser and model encode pieces when they are first
seen, many in one call; a bounded cache keeps the results. Prose repeats its words, so most pieces are found there.

Texts are cut, their pieces told apart and the ids put together as columns (Arrow, NumPy): only a piece that
is not in the cache becomes an object of its own.
"""

from __future__ import annotations

import codecs
import ctypes
import gc
import os
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces kept per generation; there are two. A piece of eight letters and four ids takes about 32 bytes.
CACHED = 1_000_000
#: Unknown pieces that one call of the library takes.
TOGETHER = 500
#: Words of Latin letters that one call takes.
WORDS = 1000
#: Longer pieces are encoded each time, so that the cache stays bounded in bytes too.
LONGEST_CACHED = 64
#: Latin letters, then perhaps ASCII signs but no apostrophe: known to split into just these two words. A
#: line's end may come before. These letters have lower case of one letter and are in normal form.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIMPLE = re.compile(r"(\n?)([" + LETTERS + r"]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
PARTS = r"\A(?P<line>\n?)(?P<letters>[" + LETTERS + r"]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)\z"
#: How a byte-level vocabulary writes a space and a line's end.
SPACE, LINE = "\u0120", "\u010a"
#: A random number for each byte at each of the first places of a piece.
MIX = np.random.default_rng(1).integers(0, 1 << 64, (256, 256), np.uint64)
UNIT = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")


def of_worker(key: tuple, make: Callable[[], object]) -> object:
    """`make()`, kept by the Python worker for its later tasks, so that caches stay warm. A worker keeps
    one thing: another key replaces it, so that stages of a job don't add up."""
    kept = sys.modules.setdefault("_riskweave_worker", types.ModuleType("_riskweave_worker")).__dict__
    if kept.get("key") != key:
        kept.pop("made", None)
        kept["made"], kept["key"] = make(), key
    return kept["made"]


def release() -> None:
    """Give up what the worker keeps, and the memory that Arrow and the C library hold ready."""
    sys.modules.pop("_riskweave_worker", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


class Cache(dict):
    """piece -> its result. Two generations: when the young one is full, it replaces the old one.

    A result of None marks a piece that cannot be taken alone.
    """

    def __init__(self, make: Callable[[str], object], size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece):
        if piece in self.old:
            value = self.old[piece]
        else:
            value = self.make(piece)
            if len(piece) > LONGEST_CACHED:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


def splits_alone(piece: str) -> bool:
    """Whether the white space around `piece` is exactly the spaces that cut it out."""
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


def hashes(pieces: pa.StringArray) -> np.ndarray:
    """64 bits of each piece: the sum of one random number for each byte at its place."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    sums = np.zeros(last - first + 1, np.uint64)
    if last > first:
        place = places(np.zeros(len(pieces), np.int32), np.diff(offsets)) % len(MIX)
        np.cumsum(MIX[place, np.frombuffer(data, np.uint8)[first:last]], out=sums[1:])
    return sums[offsets[1:] - first] - sums[offsets[:-1] - first]


class Held:
    """Distinct pieces and their ids, in columns. A count of -1 marks a piece that cannot be taken alone."""

    def __init__(self):
        self.pieces = pa.array([], pa.string())
        self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")
        #: Sorted, and the row of each.
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The row of each piece, or -1. Of equal hashes only one is looked at: then another piece counts as unknown."""
        out = np.full(len(pieces), -1, np.int32)
        if len(self) and len(pieces):
            wanted = hashes(pieces)
            order = np.argsort(wanted)
            at = np.minimum(np.searchsorted(self.hashes, wanted[order]), len(self) - 1)
            maybe = self.hashes[at] == wanted[order]
            asked, row = order[maybe], self.row[at[maybe]]
            equal = pc.equal(pieces.take(pa.array(asked)), self.pieces.take(pa.array(row))).to_numpy(zero_copy_only=False)
            out[asked[equal]] = row[equal]
        return out

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of some rows."""
        counts = self.counts[at]
        return counts, self.ids[places(self.starts[at], np.maximum(counts, 0))]

    def add(self, pieces: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        if not len(pieces):
            return
        starts = len(self.ids) + before(np.maximum(counts, 0))
        new = hashes(pieces)
        order = np.argsort(new)
        at = np.searchsorted(self.hashes, new[order])
        self.hashes = np.insert(self.hashes, at, new[order])
        self.row = np.insert(self.row, at, (len(self) + order).astype(np.int32))
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, starts.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])


def before(counts: np.ndarray) -> np.ndarray:
    """Sums of the earlier counts."""
    return np.cumsum(counts, dtype=np.int64) - counts


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """`counts[k]` places from `starts[k]` on, for each k in turn."""
    kind = np.int32 if counts.sum(dtype=np.int64) + starts.max(initial=0) < 1 << 31 else np.int64
    out = np.repeat((starts - before(counts)).astype(kind), counts)
    out += np.arange(len(out), dtype=kind)
    return out


def chosen(mask: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of the rows in the mask."""
    return counts[mask], ids[np.repeat(mask, np.maximum(counts, 0))]


def merged(mask: np.ndarray, counts: np.ndarray, ids: np.ndarray, other_counts: np.ndarray, other_ids: np.ndarray):
    """(counts, ids) of rows in the mask and those of the other rows, in order."""
    both = np.empty(len(mask), np.int32)
    both[mask], both[~mask] = counts, other_counts
    of_mask = np.repeat(mask, np.maximum(both, 0))
    out = np.empty(len(of_mask), "<u4")
    out[of_mask], out[~of_mask] = ids, other_ids
    return both, out


def as_columns(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of blobs; None counts -1."""
    counts = np.array([-1 if b is None else len(b) // 4 for b in blobs], dtype=np.int32)
    return counts, np.frombuffer(b"".join(filter(None, blobs)), dtype="<u4")


def as_blobs(counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The ids of each row, as bytes."""
    ends = (4 * np.cumsum(counts, dtype=np.int64)).tolist()
    whole = ids.tobytes()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


class PieceEncoder:
    """text -> ids as little-endian unsigned 32-bit integers, equal to encoding the text as a whole
    with `add_special_tokens=False`: strings of special tokens in a text are these tokens, and the text
    between them is encoded part by part."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.pre_tokenizer = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must match the text as it is")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        # Of tokens that begin at one place, the longest counts.
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if added else None
        self.cached = cached
        self.words: dict[str, bytes] = {}
        #: A vocabulary that drops white space has no token for a space.
        self.drops_space = not self.ids(" ")
        # How the vocabulary writes bytes of the letters that aren't ASCII, as the library's pre-tokeniser does.
        alphabet = list(map(chr, range(256)))
        for c in (chr(c) for c in range(0xC0, 0x100) if SIMPLE(chr(c))):
            written = "".join(w for w, _ in self.pre_tokenizer.pre_tokenize_str(c))
            for byte, sign in zip(c.lower().encode() if self.drops_space else c.encode(), written, strict=True):
                alphabet[byte] = sign
        self.alphabet = "".join(alphabet)
        # The model on words already written as the vocabulary does, and which tokens begin or end a word there.
        self.written = Tokenizer(self.model)
        self.written.pre_tokenizer = Split("\n", "removed")
        self.at_edge = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.at_edge[i] = token.endswith(self.model.end_of_word_suffix) if self.drops_space else token[0] == SPACE
        self.held, self.older = Held(), Held()
        self.first = Cache(self.alone, 1000)

    def ids_of_words(self, words: Iterable[str]) -> None:
        """Put the ids of words into the cache."""
        if len(self.words) >= self.cached:
            self.words = {}
        known, tokenize = self.words, self.model.tokenize
        for word in words:
            if word not in known:
                known[word] = array("I", [token.id for token in tokenize(word)]).tobytes()

    def normal(self, text: str) -> str:
        return text if self.normalizer is None or not text else self.normalizer.normalize_str(text)

    def ids(self, text: str) -> bytes:
        text = self.normal(text)
        words = [w for w, _ in self.pre_tokenizer.pre_tokenize_str(text)] if text else []
        self.ids_of_words(words)
        return b"".join([self.words[w] for w in words])

    def alone(self, piece: str, before: str = "") -> bytes | None:
        if self.drops_space:
            return self.ids(piece)
        if piece[:1] == "\n":
            return self.ids(piece) if splits_alone(piece[1:]) else None
        return self.ids(before + piece) if splits_alone(piece) else None

    def learn(self, wanted: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of distinct pieces that are not held; from now on they are, and the words in them."""
        pieces = pa.array(wanted, pa.string())
        parts = pc.extract_regex(pieces, PARTS)
        plain = pc.fill_null(pc.equal(pc.struct_field(parts, "line"), ""), False)
        counts, ids = self.learn_signed(*(pc.struct_field(parts, name).filter(plain) for name in ("letters", "signs")))
        mask = plain.to_numpy(zero_copy_only=False)
        others = pieces.filter(pc.invert(plain))
        other_counts, other_ids = self.learn_others(others.to_pylist())
        counts, ids = merged(mask, counts, ids, other_counts, other_ids)
        # Bare words are held already.
        bare = pc.fill_null(pc.equal(pc.struct_field(parts, "letters"), pieces), False)
        keep = pc.and_not(pc.less_equal(pc.utf8_length(pieces), LONGEST_CACHED), bare)
        self.held.add(pieces.filter(keep), *chosen(keep.to_numpy(zero_copy_only=False), counts, ids))
        return counts, ids

    def learn_signed(self, letters: pa.Array, signs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of pieces that are a word of Latin letters and signs after it, perhaps none. The words
        are pieces of their own, kept once."""
        words, signs = letters.dictionary_encode(), signs.dictionary_encode()
        found, counts, ids = self.look_up(words.dictionary)
        new = words.dictionary.filter(pc.invert(found))
        new_counts, new_ids = self.tokens(new)
        keep = pc.less_equal(pc.utf8_length(new), LONGEST_CACHED)
        self.held.add(new.filter(keep), *chosen(keep.to_numpy(zero_copy_only=False), new_counts, new_ids))
        counts, ids = merged(found.to_numpy(zero_copy_only=False), counts, ids, new_counts, new_ids)
        rests = signs.dictionary.to_pylist()
        self.ids_of_words(filter(None, rests))
        rest_counts, rest_ids = as_columns([self.words[rest] if rest else b"" for rest in rests])
        word, rest = words.indices.to_numpy(), signs.indices.to_numpy()
        starts = np.stack([before(counts)[word], (len(ids) + before(rest_counts))[rest]], axis=1)
        both = np.stack([counts[word], rest_counts[rest]], axis=1)
        return both.sum(axis=1, dtype=np.int32), np.concatenate([ids, rest_ids])[places(starts.ravel(), both.ravel())]

    def as_written(self, pieces: list[str]) -> str:
        """Pieces of Latin letters as the vocabulary writes them, in one go, with line's ends between."""
        return codecs.charmap_decode("\n".join(pieces).encode(), "strict", self.alphabet)[0]

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of words of Latin letters, each after its space."""
        counts, ids = [np.zeros(0, np.int32)], [np.zeros(0, "<u4")]
        for at in range(0, len(words), WORDS):
            some = words.slice(at, WORDS).to_numpy(zero_copy_only=False)
            if self.drops_space:
                text = self.as_written([word.lower() for word in some])
            else:
                text = SPACE + self.as_written(some).replace("\n", "\n" + SPACE)
            own = np.array(self.written.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            edge = np.flatnonzero(self.at_edge[own])
            if len(edge) != len(some):
                raise AssertionError("a word has one token at its edge")
            counts.append(np.diff(edge, prepend=-1) if self.drops_space else np.diff(edge, append=len(own)))
            ids.append(own)
        return np.concatenate(counts).astype(np.int32), np.concatenate(ids)

    def learn_others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of all other pieces."""
        known: dict[str, bytes | None] = {}
        begun, plain = [], []
        for piece in pieces:
            if match := SIMPLE(piece):
                begun.append((piece, *match.groups()[1:]))
            elif piece.split() == [piece]:
                plain.append(piece)
            else:
                known[piece] = self.alone(piece, " ")
        written = self.as_written([letters for _, letters, _ in begun]).split("\n")
        begun = [(piece, word, rest) for (piece, _, rest), word in zip(begun, written)]
        self.ids_of_words({rest for _, _, rest in begun if rest}.union((word for _, word, _ in begun), [LINE]))
        find = self.words.__getitem__
        for piece, word, rest in begun:
            known[piece] = find(LINE) + find(word) + (find(rest) if rest else b"")
        for at in range(0, len(plain), TOGETHER):
            known |= self.together(plain[at : at + TOGETHER])
        return as_columns([known[piece] for piece in pieces])

    def together(self, plain: list[str]) -> dict[str, bytes | None]:
        """Pieces without white space, in one call of the library: a word belongs to the piece whose
        space is the last at or before it."""
        text = self.normal(" " + " ".join(plain))
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 32)
        if len(spaces) != len(plain):
            return {piece: self.alone(piece, " ") for piece in plain}
        found = self.pre_tokenizer.pre_tokenize_str(text)
        own = np.searchsorted(spaces, [span[0] for _, span in found], side="right") - 1
        words: list[list[str]] = [[] for _ in plain]
        for (word, _), k in zip(found, own.tolist(), strict=True):
            words[k].append(word)
        self.ids_of_words([word for each in words for word in each])
        find = self.words.__getitem__
        return {piece: b"".join(map(find, each)) for piece, each in zip(plain, words, strict=True)}

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of each text, one at least. Where spaces matter, the first piece of a line keeps the line's end
        before it, and a piece that is empty or ends in white space is one that cannot be taken alone."""
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")  # A-Z lowered: fewer pieces
        return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")

    def look_up(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(which pieces are held, counts and ids of these). What only the older generation holds moves up."""
        at = self.held.find(pieces)
        if len(self.older) and (at < 0).any():
            absent = np.flatnonzero(at < 0)
            there = self.older.find(pieces.take(pa.array(absent)))
            again = absent[there >= 0]
            at[again] = len(self.held) + np.arange(len(again))
            self.held.add(pieces.take(pa.array(again)), *self.older.rows(there[there >= 0]))
        return pa.array(at >= 0), *self.held.rows(at[at >= 0])

    def columns_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of distinct pieces; what is not held is learnt."""
        if len(self.held) + len(pieces) > self.cached:
            self.held, self.older = Held(), self.held
        found, counts, ids = self.look_up(pieces)
        missed = pieces.filter(pc.invert(found)).to_numpy(zero_copy_only=False)
        return merged(found.to_numpy(zero_copy_only=False), counts, ids, *self.learn(missed))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids of all texts one after the other). Null is empty. Each text is split
        at its added tokens before anything else. The many small objects of a portion have no cycles, so the
        collector need not look at them."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        collects = gc.isenabled()
        gc.disable()
        try:
            if any(pc.any(pc.match_substring(texts, token)).as_py() for token in self.added):
                counts, ids = as_columns(self.encode_split(texts.to_pylist()))
                return counts.astype(np.int64), ids
            return self.encode_parts(texts)
        finally:
            if collects:
                gc.enable()

    def encode_split(self, texts: list[str]) -> list[bytes]:
        parts = list(map(self.at_added, texts))
        between = iter(as_blobs(*self.encode_parts(pa.array([part for own in parts for part in own[::2]], pa.string()))))
        return [
            b"".join([self.added[part] if i % 2 else next(between) for i, part in enumerate(own)]) for own in parts
        ]

    def encode_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode_column` of texts without added tokens. Each distinct piece is looked up once."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        cut = self.cut(texts)
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        at, pieces = coded.indices.to_numpy(), coded.dictionary
        counts, ids = self.columns_of(pieces)
        if not self.drops_space:  # a text's first piece has no space before it
            first, place = np.unique(at[bounds[:-1]], return_inverse=True)
            own_counts, own_ids = as_columns([self.first[piece] for piece in pieces.take(pa.array(first)).to_pylist()])
            at = at.copy()
            at[bounds[:-1]] = len(pieces) + place
            counts, ids = np.concatenate([counts, own_counts]), np.concatenate([ids, own_ids])
        each = counts[at]
        odd = np.flatnonzero(np.logical_or.reduceat(each < 0, bounds[:-1]))
        np.maximum(each, 0, out=each)
        starts = before(np.maximum(counts, 0))
        lengths = np.add.reduceat(each, bounds[:-1], dtype=np.int64)
        out = ids[places(starts[at], each)]
        if not len(odd):
            return lengths, out
        # Some white space is not a single space between pieces.
        ends, done, parts = np.cumsum(lengths), 0, []
        for k in odd.tolist():
            whole = np.frombuffer(b"".join(map(self.ids, UNIT.findall(texts[k].as_py()))), dtype="<u4")
            parts += [out[done : ends[k] - lengths[k]], whole]
            done, lengths[k] = ends[k], len(whole)
        return lengths, np.concatenate([*parts, out[done:]])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return as_blobs(*self.encode_column(pa.array(texts, pa.string())))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]
