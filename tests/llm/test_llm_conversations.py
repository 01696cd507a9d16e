"""Operator 13 against a search of all edits."""

import hashlib
import re
import zlib
from functools import cache
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import conversations
from riskweave.llm.queries import QUERIES, damaged

VALID = re.compile(r"(s?(ua)+)?\Z")
BARE = re.compile("[^\x20\x09-\x0d]")


def first_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = BARE.findall(text)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by plain recursion over (row, initials so far, reduced to what decides)."""
    found = first_faults(rows)

    @cache
    def best(i, last):
        # last: "" nothing yet, else the last initial; after "u" only "a" may come, and so on.
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        for name in ("user", "assistant"):
            # Two insertions in a row before a row are always enough.
            if name[0] in allowed and (i, last) not in inserting:
                inserting.append((i, last))
                rest = best_after_insert(i, name[0], 1)
                inserting.pop()
                options += [(c + 2, "I" + a, ((name, ""), *r)) for c, a, r in rest]
        options += edited(i, allowed, last)
        return min(options, default=None)

    def best_after_insert(i, last, used):
        allowed = {"s": "u", "u": "a", "a": "u"}[last]
        out = []
        if i == len(rows) and last == "a":
            out.append((0, "", ()))
        if used < 3:
            for name in ("user", "assistant"):
                if name[0] in allowed:
                    out += [
                        (c + 2, "I" + a, ((name, ""), *r)) for c, a, r in best_after_insert(i, name[0], used + 1)
                    ]
        return out + edited(i, allowed, last)

    def edited(i, allowed, last):
        out = []
        if i < len(rows):
            _, role, text = rows[i]
            rest = best(i + 1, last)
            if rest:
                out.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if found[i] not in ("blank", "duplicate"):
                extra = found[i] == "truncated"
                kept = [(role, 0, "K")] if role[:1] else []
                for name, cost, letter in [*kept, ("user", 2, "R"), ("assistant", 2, "R")]:
                    if name[0] in allowed:
                        rest = best(i + 1, name[0])
                        if rest:
                            out.append((rest[0] + cost + extra, letter + rest[1], ((name, text), *rest[2])))
        return out

    inserting = []
    return best(0, "")


def expected(rows):
    """`rows`: (turn, role, text) in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = first_faults(rows)
    cost, audit, repaired = cheapest(tuple(rows))
    assert VALID.match("".join(role[0] for role, _ in repaired))
    turns = {t for t, _, _ in rows} - {None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(found.count(kind) for kind in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    )


def by_conversation(rows):
    """conv -> its (turn, role, text) in order, of (conv, turn, role, text or None)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = (turn, " " if role is None else role, " " if text is None else text)
        out.setdefault(conv, []).append(kept)
    return {
        conv: sorted(each, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        for conv, each in out.items()
    }


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def after_damage(rows):
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out, ids


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/../sf0.01/conversations.parquet'").fetchall()
    got = rows_of(QUERIES["op13_conversations"](spark, f"{sf_dir}/../sf0.01"))
    left, ids = after_damage(rows)
    grouped = by_conversation(left)
    assert got == {conv: expected(grouped.get(conv, [])) for conv in ids}
    assert any(v[5] > 0 for v in got.values())


def test_damage_of_nulls_and_lost_conversations(spark):
    rows = [(c, t, r, x) for c in [None, *range(60)] for t, r, x in [(None, "user", "Hi."), (3, None, None), (7, "assistant", "Oh!")]]
    rows += [(1000 + i, 1, "user", "What? ") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = rows_of(conversations.repair(damaged(df), present="present"))
    left, ids = after_damage(rows)
    grouped = by_conversation(left)
    assert len(ids) > len(grouped)
    assert got == {conv: expected(grouped.get(conv, [])) for conv in ids}


TEXTS = st.sampled_from(["Yes.", "No!", "cut off", "", " \n", "ok? \t", "é日本"])
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "unknown", None])
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), ROLES, st.one_of(st.none(), TEXTS)), max_size=9)


@settings(max_examples=150, deadline=None, database=None)
@given(ROWS)
def test_agenda_finds_the_cheapest_edits(rows):
    ordered = by_conversation([(1, *r) for r in rows]).get(1, [])
    if ordered:
        got = conversations.whole([conversations.Row(*r) for r in ordered])
        assert tuple(got[c] for c in COLUMNS) == expected(ordered)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_portions_give_the_same_results(spark, size):
    texts, roles = ["Yes.", "No!", "cut off", "", "Well?"], ["user", "assistant", "system", None]
    rows = [
        (None if conv == 3 else conv, None if (turn * conv) % 5 == 4 else turn // 2, roles[(turn * 7 + conv) % 4], texts[(turn * turn + conv) % 5], "x")
        for conv in range(8)
        for turn in range(conv * 2)
    ]
    rows += [(99, 1, "user", "Same.", "x")] * 12 + [(98, None, "user", f"{i}.", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, portion string")
    grouped = by_conversation([r[:4] for r in rows])
    assert rows_of(conversations.repair(df, portion_rows=size)) == {c: expected(g) for c, g in grouped.items()}


def test_chained_portions_choose_as_one_agenda():
    for letters in product("usa", repeat=4):
        shape = tuple((letter, fault) for letter, fault in zip(letters, (0, 3, 0, 3), strict=True))
        whole = conversations.lightest(shape, conversations.START, conversations.ACCEPTED)
        parts = [
            (k, [
                {"entry": entry, "end": end, "cost": cost, "audit": audit}
                for entry in conversations.STATES
                for end, (cost, audit) in conversations.lightest((row,), entry, None).items()
            ])
            for k, row in enumerate(shape)
        ]
        links = conversations.chain(parts)
        assert [(links[-1].total, "".join(p.way["audit"] for p in links))] == list(whole.values())


def test_edges(spark):
    schema = "conv_id string, turn long, role string, text string, conv long, here string"
    assert conversations.repair(spark.createDataFrame([], schema)).isEmpty()
    long_text = "word " * 200_000
    rows = [("", 1, "user", long_text, 1, "y"), ("", 2, "assistant", None, 1, "y"), (None, None, None, None, 1, None)]
    got = rows_of(conversations.repair(spark.createDataFrame(rows, schema)))
    assert got == {c: expected(g) for c, g in by_conversation([r[:4] for r in rows]).items()}
    gone = conversations.repair(spark.createDataFrame(rows, schema).withColumn("here", F.lit(False)), present="here")
    assert set(rows_of(gone).values()) == {expected([])}
