"""Conversation repair (operator 13): the cheapest edits that give an alternating conversation, by Knuth's
lightest-derivation agenda.

A conversation is in order if the initials of its roles spell `(s?(ua)+)?`. Its rows are read in the order of
turn (null first), role and text. Items are (rows consumed, state of that grammar). A deduction joins an item
with an edit of its next row (keep, rerole, delete) or with an insertion, and weighs the sum of the costs and the
audit, the edits' initials, with one letter more. Such functions are monotone: equal costs over the same rows
never give audits of which one begins the other, so what is smaller stays smaller. They are superior in the
order (cost, rows consumed, audit): each deduction adds to the cost or to the rows. So the agenda pops every item
at its lightest, and the goal, when popped, is final.

Conversations of at most `LONG` rows are dealt out by id and solved whole. Longer ones are cut into portions
of `LONG` rows with exact positions; each portion is solved from every state to every state, in parallel, and
the results are chained, one small row per portion. So no group is held in a task, however long a conversation
is, except the audit, which is one value of the result. Repeats within long conversations are found by a
grouping of text hashes, whose most frequent keys are broadcast. Both ways give equal results.

The digest of a long conversation is sequential, as any SHA-256: its rows stream through one task, in order,
in constant memory.

Nulls: a null id is a conversation of its own; a null turn comes first and counts in no gap; a null role or
text is one space. Rows equal in turn, role and text are interchangeable. Empty texts are blank. A conversation
of no present rows gives zeros, an empty audit and the hash of the empty text; an empty table gives no rows.
Input columns other than the four (and `present`) are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WHITE, join_by_group, stored
from riskweave.llm.ordered import prefix_sums

#: Rows of a conversation that are solved together.
LONG = 1_000

#: States: nothing yet, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ACCEPTED = (START, ASSISTANT)
#: state -> {initial of the next role: state after it}
STEPS = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: First fault of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def edits(initial: str, fault: int) -> list[tuple[str | None, int, str]]:
    """(initial of the row's role, null if it goes; cost; letter of the audit) for each edit of a row."""
    out = [(None, DELETE, "D")]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        out += [(initial, extra, "K")]
        out += [(name, REROLE + extra, "R") for name in NAMES]
    return out


@lru_cache(maxsize=100_000)
def lightest(rows: tuple[tuple[str, int], ...], entry: int, goals: tuple[int, ...] | None) -> dict:
    """state at the end -> (cost, audit) of the lightest derivation from `entry` over all rows (initial,
    fault). With `goals`, only the lightest of these states."""
    agenda = [(0, 0, "", entry)]
    final: set[tuple[int, int]] = set()
    ends = {}
    while agenda:
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if goals is None:
                ends[state] = (cost, audit)
            elif state in goals:
                return {state: (cost, audit)}
        else:
            for initial, weight, letter in edits(*rows[i]):
                after = state if initial is None else STEPS[state].get(initial)
                if after is not None and (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + weight, i + 1, audit + letter, after))
        for initial in NAMES:
            after = STEPS[state].get(initial)
            if after is not None and (i, after) not in final:
                heapq.heappush(agenda, (cost + INSERT, i, audit + "I", after))
    return ends


def replay(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text): the audit and the state before it tell every role."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            role = NAMES["a" if state == USER else "u"]
        state = STEPS[state][role[:1]]
        yield role, text


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    repeated: bool | None = None


def faults(rows: list[Row]) -> list[int]:
    """The first fault of each row. Without `repeated`, the rows are a whole conversation."""
    seen = set()
    out = []
    for row in rows:
        bare = row.text.rstrip(WHITE)
        repeated = (row.role, row.text) in seen if row.repeated is None else row.repeated
        seen.add((row.role, row.text))
        if not bare:
            out.append(BLANK)
        elif repeated:
            out.append(DUPLICATE)
        else:
            out.append(SOUND if bare[-1] in ".!?" else CUT)
    return out


def digest_of(pairs: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in pairs).encode()).hexdigest()


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def counts(rows: list[Row], found: list[int]) -> dict[str, int]:
    initials = [row.role[:1] for row in rows]
    return {
        "blank": found.count(BLANK),
        "duplicate": found.count(DUPLICATE),
        "truncated": found.count(CUT),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
    }


def whole(rows: list[Row]) -> dict:
    """The result of one conversation."""
    found = faults(rows)
    turns = {row.turn for row in rows} - {None}
    shape = tuple((row.role[:1], fault) for row, fault in zip(rows, found, strict=True))
    ((cost, audit),) = lightest(shape, START, ACCEPTED).values()
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **counts(rows, found),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": digest_of(replay(((row.role, row.text) for row in rows), audit, START)),
    }


RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
PORTION = (
    "conv string, portion long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, "
    "blank long, duplicate long, truncated long, illegal long, ways array<struct<entry:int,end:int,cost:long,audit:string>>"
)


def key_of(conv_id: str) -> Column:
    """A missing id is told from the text of any id."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], fields: tuple[str, ...]) -> Iterator[tuple]:
    """(key, iterator of the rows) of consecutive rows of equal keys, over batches that hold the rows sorted."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, *fields)]
            yield from zip(*columns, strict=True)

    n = len(key)
    for value, group in groupby(rows(), key=lambda row: row[:n]):
        yield value, (row[n:] for row in group)


def emitted(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield emitted(held, schema)
            held = []
    if held:
        yield emitted(held, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    ways = pa.list_(
        pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    )
    fields = [part.strip().split(" ", 1) for part in ddl.replace("struct<entry:int,end:int,cost:long,audit:string>", "ways").split(",")]
    return pa.schema([(name, ARROW.get(kind, ways)) for name, kind in fields])


def solved_whole(rows: DataFrame) -> DataFrame:
    """Results of conversations short enough for a task. Equal turns, roles and texts need no further order."""
    ordered = rows.repartition("conv").sortWithinPartitions("conv", *in_order())
    ddl = f"conv string, {RESULT}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = (
            {"conv": conv, **whole([Row(*row) for row in group])}
            for (conv,), group in runs(batches, ("conv",), ("turn", "role", "text"))
        )
        yield from in_batches(solved, schema)

    return ordered.select("conv", "turn", "role", "text").mapInArrow(run, ddl)


def placed(rows: DataFrame, portion_rows: int) -> DataFrame:
    """Adds `position` in the conversation and `portion`, to the rows of long conversations. Rows that are
    equal in all that matters are spread by their place in the table."""
    spread = rows.withColumn("one", F.lit(1)).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    spread = stored(spread, "long-rows")
    summed = stored(prefix_sums(spread, [F.col("conv"), *in_order(), F.col("spread")], ["one"], "long-order"), "long-sums")
    starts = summed.groupBy("conv").agg(F.min("one_before").alias("start"), F.count(F.lit(1)).alias("n"))
    starts = stored(starts, "long-starts")
    joined = join_by_group(summed, starts, "conv", "n", summed.count())
    position = F.col("one_before") - F.col("start")
    return joined.select(
        "conv",
        "turn",
        "role",
        "text",
        position.alias("position"),
        F.floor(position / F.lit(portion_rows)).cast("long").alias("portion"),
        F.sha2(F.to_json(F.struct("conv", "role", "text")), 256).alias("same"),
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds `repeated`: the role and text came earlier in the conversation."""
    rows = stored(rows, "long-placed")
    first = rows.groupBy("same").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n"))
    joined = join_by_group(rows, stored(first, "long-first"), "same", "n", rows.count())
    return stored(joined.withColumn("repeated", F.col("position") > F.col("first_position")), "long-marked")


def solved_portions(rows: DataFrame) -> DataFrame:
    schema = arrow_schema(PORTION)

    def solve(conv: str, portion: int, rows: list[Row]) -> dict:
        found = faults(rows)
        turns = [row.turn for row in rows if row.turn is not None]
        shape = tuple((row.role[:1], fault) for row, fault in zip(rows, found, strict=True))
        ways = [
            {"entry": entry, "end": end, "cost": cost, "audit": audit}
            for entry in STATES
            for end, (cost, audit) in lightest.__wrapped__(shape, entry, None).items()
        ]
        return {
            "conv": conv,
            "portion": portion,
            "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None,
            "turns": len(set(turns)),
            "first_initial": rows[0].role[:1],
            "last_initial": rows[-1].role[:1],
            **counts(rows, found),
            "ways": ways,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("turn", "role", "text", "repeated")
        for (conv, portion), group in runs(batches, ("conv", "portion"), fields):
            yield emitted([solve(conv, portion, [Row(*row) for row in group])], schema)

    ordered = rows.repartition("conv", "portion").sortWithinPartitions("conv", "portion", "position")
    return ordered.select("conv", "portion", "turn", "role", "text", "repeated").mapInArrow(run, PORTION)


class Path(NamedTuple):
    """The lightest way to a state: the path to the portion's entry, and the way through it."""

    before: Path | None
    portion: int
    way: dict
    total: int

    def audits_since(self, other: Path) -> tuple[str, str]:
        """Audits of two paths over the same portions, from where they part."""
        mine, theirs = self, other
        parts: list[tuple[str, str]] = []
        while mine is not theirs:
            parts.append((mine.way["audit"], theirs.way["audit"]))
            mine, theirs = mine.before, theirs.before
        return tuple("".join(reversed(side)) for side in zip(*parts, strict=True)) if parts else ("", "")

    def lighter_than(self, other: Path | None) -> bool:
        if other is None or self.total != other.total:
            return other is None or self.total < other.total
        mine, theirs = self.audits_since(other)
        return mine < theirs


def chain(portions: Iterable[tuple[int, list[dict]]]) -> list[Path]:
    """The lightest derivation through (portion, ways) from the start to an accepted end, a link per portion."""
    best: dict[int, Path | None] = {START: None}
    for portion, ways in portions:
        reached: dict[int, Path] = {}
        for way in ways:
            if way["entry"] in best:
                before = best[way["entry"]]
                path = Path(before, portion, way, way["cost"] + (before.total if before else 0))
                if path.lighter_than(reached.get(way["end"])):
                    reached[way["end"]] = path
        best = reached
    at: Path | None = None
    for state in ACCEPTED:
        if state in best and best[state].lighter_than(at):
            at = best[state]
    links = []
    while at:
        links.append(at)
        at = at.before
    return links[::-1]


def solved_long(rows: DataFrame, portion_rows: int) -> DataFrame:
    """Results of long conversations: portions, chained, then the rows once more for the digest."""
    marked = with_repeats(placed(rows, portion_rows))
    portions = stored(solved_portions(marked), "long-portions")
    chosen_ddl = "conv string, portion long, entry int, audit string, cost long"
    chosen_schema = arrow_schema(chosen_ddl)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in runs(batches, ("conv",), ("portion", "ways")):
            rows = (
                {"conv": conv, "portion": link.portion, **{k: link.way[k] for k in ("entry", "audit", "cost")}}
                for link in chain(group)
            )
            yield from in_batches(rows, chosen_schema, 64)

    ordered = portions.repartition("conv").sortWithinPartitions("conv", "portion").select("conv", "portion", "ways")
    chosen = stored(ordered.mapInArrow(choose, chosen_ddl), "long-chosen")

    # Rows of one conversation stream through one task: a SHA-256 has no other way.
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("portion", "role", "text", "entry", "audit")
        for (conv,), group in runs(batches, ("conv",), fields):
            hashed, gap = hashlib.sha256(), b""
            for _, part in groupby(group, key=lambda row: row[0]):
                held = list(part)
                pairs = ((role, text) for _, role, text, _, _ in held)
                for role, text in replay(pairs, held[0][4], held[0][3]):
                    hashed.update(gap + f"{role}:{text}".encode())
                    gap = b"\n"
            row = {"conv": conv, "repaired_sha256": hashed.hexdigest()}
            yield emitted([row], arrow_schema("conv string, repaired_sha256 string"))

    audits = F.when(F.col("position") % portion_rows == 0, F.col("audit")).alias("audit")
    streamed = marked.join(chosen.drop("cost"), ["conv", "portion"]).select(
        "conv", "portion", "position", "role", "text", "entry", audits
    )
    streamed = streamed.repartition("conv").sortWithinPartitions("conv", "position").drop("position")
    digests = streamed.mapInArrow(digest, "conv string, repaired_sha256 string")

    # One row per portion: bounded by the rows of a conversation over `portion_rows`.
    follows = Window.partitionBy("conv").orderBy("portion")
    before = F.last("last_turn", ignorenulls=True).over(follows.rowsBetween(Window.unboundedPreceding, -1))
    border = F.concat(F.lag("last_initial").over(follows), F.col("first_initial"))
    bordered = portions.select(
        "*",
        (F.col("first_turn") == before).alias("turn_goes_on"),
        (border.isNotNull() & ~border.isin(*LEGAL)).alias("illegal_border"),
    )
    distinct_turns = F.sum("turns") - F.count_if("turn_goes_on")
    spread = F.max("last_turn") - F.min("first_turn") + 1 - distinct_turns
    summed = bordered.groupBy("conv").agg(
        F.coalesce(spread, F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in COUNTS if c != "illegal"),
        (F.sum("illegal") + F.count_if("illegal_border")).alias("illegal"),
    )
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("portion", "audit"))), lambda p: p["audit"]), "")
    costs = chosen.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    names = [field.split()[0] for field in RESULT.split(", ")]
    return summed.join(costs, "conv").join(digests, "conv").select("conv", *names)


def repair(rows: DataFrame, present: str | None = None, portion_rows: int = LONG) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Rows whose `present` is false only name their conversation."""
    here = F.col(present) if present else F.lit(True)
    named = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        here.alias("here"),
        key_of("conv_id").alias("conv"),
    )
    ids = named.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.count_if("here").alias("n"))
    ids = stored(ids, "conversations")
    long_ones = ids.where(F.col("n") > portion_rows).select("conv", "n")
    body = named.where("here").select("conv", "turn", "role", "text")
    if long_ones.isEmpty():
        solved = solved_whole(body)
    else:
        # A long conversation has over `portion_rows` rows, so this join's small side is a small part of the rows.
        total = named.count()
        is_long = stored(join_by_group(body, ids.select("conv", "n"), "conv", "n", total), "conversation-rows")
        short = solved_whole(is_long.where(F.col("n") <= portion_rows).drop("n"))
        solved = short.unionByName(solved_long(is_long.where(F.col("n") > portion_rows).drop("n"), portion_rows))
    empty = hashlib.sha256(b"").hexdigest()
    joined = ids.drop("n").join(stored(solved, "solved"), "conv", "left").drop("conv")
    zeros = {field.split()[0]: 0 for field in RESULT.split(", ") if field.endswith("long")}
    return joined.fillna({**zeros, "audit": "", "repaired_sha256": empty})
