"""Byte-level BPE (operator 6): encoding by a lazily determinised transducer, streaming decoding.

**Encoding.** The merges define which tokens may stand side by side: (s, t) is allowed when merging the
bytes of both by rank gives [s, t] again. A sequence of tokens is the encoding of its bytes exactly when
all neighbours are allowed, so every prefix of a text has one encoding. A nondeterministic transducer
reads bytes down the trie of tokens and may end an allowed token after any byte. Its determinised states
hold all live hypotheses: the token before and the place in the trie. A hypothesis lives no longer than
the longest token, which bounds the lookahead after which a token is certain and can be emitted. States
and transitions are made when first needed and kept in a bounded table.

A match of the splitting pattern that is itself a token is that token, as the rank files want it. The
transducer runs once for each distinct piece of text in the worker's bounded cache.

**Decoding.** Bytes of tokens are fed to a UTF-8 state machine that hands out complete characters and
keeps an unfinished one, at most three bytes, for the next tokens; ill-formed bytes give U+FFFD.

A null text is empty and has no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.pieces import UNIT, Cache, of_worker, splits_alone

#: Determinised states kept before the table starts anew, and known neighbours.
STATES = 250_000
#: Matches, and pieces between spaces, whose ids a worker keeps per generation.
CACHED = 300_000
NEIGHBOURS = 400_000
#: Bytes after which certain tokens of one long match are emitted; longer than any token.
LOOKAHEAD = 1024
NODE_BITS = 20
NODE_MASK = (1 << NODE_BITS) - 1
NEVER = 1 << 30
#: Tokens that a task gathers before it hands them on.
BATCH_TOKENS = 1 << 20
ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class State(dict):
    """byte -> (state after it, last token then); an entry is made when it is first asked for. `living` is
    what the state stands for."""

    __slots__ = ("living", "transducer")

    def __missing__(self, byte: int) -> tuple[State, int]:
        found = self[byte] = self.transducer.move(self.living, byte)
        return found


class Transducer:
    """Bytes -> ids. After each byte the transducer names the last token of the encoding of all bytes
    read so far; where that token begins, the same holds, so the names lead back to the whole encoding.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        # The trie: node and byte -> node, the token that ends at a node (or -1), whether it goes on.
        self.below: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.below.get(key, -1)
                if node < 0:
                    node = self.below[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = rank
        self.longest = max(map(len, ranks))
        self.neighbours: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self.states = {}
        self.start_anew()

    def start_anew(self) -> None:
        for state in self.states.values():
            state.clear()  # states refer to each other
        # What lives in a state, as (token before + 1) << NODE_BITS | node, oldest hypotheses first -> the state.
        self.states: dict[tuple[int, ...], State] = {}
        self.start = self.state((ROOT,))

    def state(self, living: tuple[int, ...]) -> State:
        found = self.states.get(living)
        if found is None:
            found = self.states[living] = State()
            found.living, found.transducer = living, self
        return found

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """A few bytes merged by the definition, lowest rank first, down to `least` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > least:
            found = [(ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge_parts(self, token: int) -> tuple[list, list]:
        """What stands at the left and at the right edge of a token while its bytes merge, from the
        token back to a byte: (bytes, when it was made, when it is used up), times as ranks. Both are
        empty if merging the bytes doesn't give the token."""
        known = self.edges.get(token)
        if known is None:
            data = self.token_bytes[token]
            if len(data) == 1:
                known = ([(data, -1, NEVER)], [(data, -1, NEVER)])
            else:
                halves = self.merged(data, 2)
                if len(halves) != 2:
                    known = ([], [])
                else:
                    left, right = (self.edge_parts(self.ranks[h])[k] for k, h in enumerate(halves))
                    whole = (data, token, NEVER)
                    known = tuple([whole, *((d, made, min(used, token)) for d, made, used in side)] for side in (left, right))
            self.edges[token] = known
        return known

    def allowed(self, s: int, t: int) -> bool:
        """Whether token t may follow s (-1: nothing before): no merge across the border comes before
        the merges that use up what stands at it."""
        key = (s + 1) << NODE_BITS | t
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) >= NEIGHBOURS:
                self.neighbours.clear()
            known = self.neighbours[key] = self.stays_apart(s, t)
        return known

    def stays_apart(self, s: int, t: int) -> bool:
        after = self.edge_parts(t)[0]
        if s < 0 or not after:
            return bool(after)
        before = self.edge_parts(s)[1]
        i = j = 0
        while True:
            a, made_a, used_a = before[i]
            b, made_b, used_b = after[j]
            across = self.ranks.get(a + b, NEVER)
            # Of equal ranks the left merge comes first.
            if across < used_a and across <= used_b and across != NEVER:
                return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # go back to before the later of the two was made
                i += 1
            else:
                j += 1

    def move(self, living: tuple[int, ...], byte: int) -> tuple[State, int]:
        """The state after `byte` and the last token then; made once, when first needed."""
        after, last = [], -1
        below, ends, inner = self.below, self.ends, self.inner
        for code in living:
            node = below.get((code & NODE_MASK) << 8 | byte)
            if node is None:
                continue
            token = ends[node]
            if last < 0 <= token and self.allowed((code >> NODE_BITS) - 1, token):
                last = token  # no other hypothesis can end here: an encoding is unique
            if inner[node]:
                after.append(code & ~NODE_MASK | node)
        after.append((last + 1) << NODE_BITS | ROOT)
        return self.state(tuple(after)), last

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > STATES:
            self.start_anew()
        out: list[int] = []
        lasts: list[int] = []
        state = self.start
        if len(data) <= LOOKAHEAD:
            for byte in data:
                state, last = state[byte]
                lasts.append(last)
            return self.traced(lasts, len(lasts))
        for at in range(0, len(data), LOOKAHEAD):
            if lasts:
                lasts = self.emit_certain(lasts, out)
            for byte in data[at : at + LOOKAHEAD]:
                state, last = state[byte]
                lasts.append(last)
        return out + self.traced(lasts, len(lasts))

    def traced(self, lasts: list[int], at: int) -> list[int]:
        back = []
        length = self.length
        while at > 0:
            token = lasts[at - 1]
            back.append(token)
            at -= length[token]
        back.reverse()
        return back

    def emit_certain(self, lasts: list[int], out: list[int]) -> list[int]:
        """Emit what all encodings of longer texts share. A token is at most `longest` bytes long, so
        the next border lies in the last `longest` places; the traces from all of these share it."""
        ends = range(len(lasts) - self.longest, len(lasts) + 1)
        traces = [self.traced(lasts, at) for at in ends]
        sure = 0
        while all(len(t) > sure for t in traces) and len({t[sure] for t in traces}) == 1:
            sure += 1
        out += traces[0][:sure]
        return lasts[sum(self.length[t] for t in traces[0][:sure]) :]


# UTF-8 as a state machine: bytes still missing, and the range of the next byte.
def utf8_step(missing: int, low: int, high: int, byte: int) -> tuple[int, int, int]:
    """The next (missing, low, high); missing is -1 when the byte is ill-formed here."""
    if missing:
        return (missing - 1, 0x80, 0xBF) if low <= byte <= high else (-1, 0, 0)
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return -1, 0, 0


def unfinished(data: bytes) -> int:
    """How many bytes at the end begin a character that is not complete; found in the last three."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead < 0x80:
            return 0
        if lead >= 0xC0:
            state = (0, 0, 0)
            for byte in data[-back:]:
                state = utf8_step(*state, byte)
                if state[0] <= 0:
                    return 0
            return back
    return 0


class StreamDecoder:
    """ids in any portions -> text in portions; `end` closes the stream."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes, self.held = token_bytes, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.token_bytes.__getitem__, ids))
        keep = unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.token_bytes = self.transducer.token_bytes
        self.matches = regex.compile(pattern).findall
        self.words = Cache(self.word, CACHED)
        self.inner = Cache(lambda p: self.piece(" " + p) if splits_alone(p) else None, CACHED)
        self.first = Cache(lambda p: self.piece(p) if splits_alone(p) else None, 1000)

    def word(self, match: str) -> tuple[int, ...]:
        data = match.encode()
        whole = self.transducer.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.transducer.encode(data))

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of a text between borders. A match that is a space and one more piece is looked up as that
        piece, so it is kept once, whether it was met alone or with signs behind it."""
        matches = self.matches(text)
        if len(matches) == 1:
            return self.word(text)
        out: list[int] = []
        for match in matches:
            out += self.inner[match[1:]] if match[0] == " " and splits_alone(match[1:]) else self.words[match]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. Pieces between single spaces encode alone; a text with other white
        space around its spaces is taken in units of white space and what follows."""
        pieces = text.split(" ")
        try:
            return [*self.first[pieces[0]], *chain.from_iterable(map(self.inner.__getitem__, pieces[1:]))]
        except TypeError:
            return list(chain.from_iterable(map(self.piece, UNIT.findall(text))))

    def decode(self, ids: Iterable[int], portion: int = 8192) -> Iterator[str]:
        decoder = StreamDecoder(self.token_bytes)
        ids = list(ids)
        for at in range(0, len(ids), portion):
            yield decoder.feed(ids[at : at + portion])
        yield decoder.end()


def without_collector(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function without Python's cycle collector: it would walk the states and caches again and again,
    and nothing here leaves cycles behind (`start_anew` takes the states apart)."""

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet


def _select(docs: DataFrame, id_col: str, col: str, alias: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).alias(alias))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id` and `ids` of every whole text."""

    @without_collector
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = of_worker(("codec", path, pattern), lambda: Codec(path, pattern))
        for batch in batches:
            keys, ids, held = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                ids.append(codec.encode(text.as_py() or ""))
                held += len(ids[-1])
                if held >= BATCH_TOKENS:
                    yield portion(keys, ids)
                    keys, ids, held = [], [], 0
            if keys:
                yield portion(keys, ids)

    def portion(keys, ids):
        columns = [pa.array(keys, type=pa.int64()), pa.array(ids, type=pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    return _select(docs, id_col, text_col, "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`doc_id` and `text` of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = of_worker(("decoder", path), lambda: Codec(path, "(?!)"))
        for batch in batches:
            texts = [None if x is None else "".join(codec.decode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return _select(encoded, id_col, ids_col, "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids_sha256` (of the decimal ids joined by commas) and `decoded_sha256` (of
    the bytes decoded from these ids), in one pass: no ids leave the task."""

    @without_collector
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = of_worker(("codec", path, pattern), lambda: Codec(path, pattern))
        decimal = {i: str(i) for i in codec.token_bytes}
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for decoded in codec.decode(ids):
                    digest.update(decoded.encode())
                of_bytes.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, type=pa.int64()), pa.array(of_ids, type=pa.string()), pa.array(of_bytes, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _select(docs, id_col, text_col, "text").mapInArrow(run, schema)
