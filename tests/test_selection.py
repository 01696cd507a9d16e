import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.operators.selection import RankFinder, at_or_before


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        group = "hot" if rng.random() < 0.6 else rng.choice(["x", "y"])
        # Half of all rows share one value of the first column.
        value = 7 if rng.random() < 0.5 else rng.randint(-(10**12), 10**12)
        out.append((group, value, rng.choice(["", "a", "ab", "b", "é"]) + format(i, "x")))
    return out


@pytest.mark.parametrize("fetch", [1, 5, 10_000])
@pytest.mark.parametrize("order", [["v", "id"], ["id"], ["id", "v"]])
def test_keys_equal_sorting(spark, rows, fetch, order):
    df = spark.createDataFrame(rows, "g string, v bigint, id string")
    place = {"v": 1, "id": 2}

    def key(r):
        return tuple(r[place[c]].encode() if c == "id" else r[place[c]] for c in order)

    finder = RankFinder(df, order, group="g", fetch_rows=fetch)
    asked = {"hot": [1, 2, 250, 251, 10**6], "x": [0, 1, 50], "y": [77], "none": [1]}
    found = finder.keys_at(asked)
    want = {}
    for g, ranks in asked.items():
        ordered = sorted((r for r in rows if r[0] == g), key=key)
        for r in ranks:
            if 1 <= r <= len(ordered):
                want[(g, r)] = tuple(ordered[r - 1][place[c]] for c in order)
    assert found == want
    last = found[("hot", 250)]
    assert df.filter(F.col("g") == "hot").filter(at_or_before(order, last)).count() == 250


def test_no_groups_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "g string, v bigint, id string")
    finder = RankFinder(df, ["v", "id"], fetch_rows=3)
    ordered = sorted((r[1:] for r in rows), key=lambda r: (r[0], r[1].encode()))
    assert finder.keys_at({None: [400]}) == {(None, 400): ordered[399]}
    assert RankFinder(df.limit(0), ["v", "id"]).keys_at({None: [1]}) == {}
    assert RankFinder(df.limit(0), ["id"]).keys_at({None: [1]}) == {}


def test_key_that_is_not_unique_is_an_error(spark):
    df = spark.createDataFrame([(1,)] * 50, "v bigint")
    with pytest.raises(ValueError):
        RankFinder(df, ["v"], fetch_rows=10).keys_at({None: [3]})


def test_unsupported_types(spark):
    with pytest.raises(TypeError):
        RankFinder(spark.createDataFrame([([1],)], "v array<int>"), ["v"])


KEYS = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, -1e300, 5e-324, 1e300, 2.0**53, 2.0**53 + 2]


def spark_order(value):
    if value is None:
        return (0,)
    if isinstance(value, float):
        return (2,) if value != value else (1, value + 0.0)
    return (1, value.encode()) if isinstance(value, str) else (1, value)


@pytest.mark.parametrize(
    "kind, fetch", [("double", 2), ("double", 10_000), ("string", 3), *((k, 10_000) for k in ("bigint", "timestamp_ntz", "string", "date", "boolean"))]
)
def test_blocks_of_any_key_are_exact(spark, fetch, kind):
    """NULL, NaN, repeated keys and equal rows: blocks have their exact sizes and follow the order."""
    from riskweave.operators.shards import contiguous_shards

    rng = random.Random(kind)
    t0 = datetime(1999, 12, 31, 23, 59, 59, 999_999)
    values = {
        "double": KEYS,
        "bigint": [None, -(2**63), 2**63 - 1, 2**53 + 1, 2**53, 0, -1],
        "timestamp_ntz": [None, t0, t0 + timedelta(microseconds=1), datetime(1969, 1, 1)],
        "string": [None, "", "a", "a\x00", "same beginning of a text, x", "same beginning of a text, é", "ab" * 300],
        "date": [None, date(1960, 2, 29), date(2024, 1, 1)],
        "boolean": [None, True, False],
    }[kind]
    picked = [(rng.choice(values), rng.randint(0, 2)) for _ in range(101)]
    df = spark.createDataFrame(picked, f"v {kind}, w int")
    got = contiguous_shards(df, 4, ["v"], fetch).collect()
    blocks = [[spark_order(r.v) for r in got if r.shard == k] for k in range(4)]
    assert [len(b) for b in blocks] == [26, 25, 25, 25]
    assert all(max(a) <= min(b) for a, b in zip(blocks, blocks[1:]))
    assert set(got[0].asDict()) == {"v", "w", "shard"}


def test_three_passes_whatever_the_keys(spark):
    for key in ("id % 3", "CASE WHEN id % 2 = 0 THEN 7 ELSE id * id END", "md5(CAST(id AS STRING))"):
        df = spark.range(30_000).select(F.expr(key).alias("k"), "id")
        finder = RankFinder(df, ["k", "id"], fetch_rows=500)
        found = finder.keys_at({None: [1, 7_500, 15_000, 30_000]})
        assert len(found) == 4 and finder.passes == 3
        counts = df.agg(*(F.count_if(at_or_before(["k", "id"], last)) for last in found.values())).first()
        assert list(counts) == [rank for _, rank in found]


def test_text_with_a_long_common_beginning(spark):
    df = spark.range(2_000).select(F.concat(F.repeat(F.lit("x"), 5_000), F.lpad("id", 4, "0")).alias("k"))
    last = RankFinder(df, ["k"], fetch_rows=10).keys_at({None: [777]})[None, 777]
    assert last[0].endswith("0776")


def test_rows_without_bank_or_label_are_split_too(spark):
    from riskweave.operators import shards

    rows = [(i, [None, "A", "B"][i % 3], [None, 0, 1, 5][i % 4], [1.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, bank_id string, label int, features array<double>")
    held = shards.pooled_holdout(df, 0.25, 1).collect()
    assert all(r.is_holdout is not None for r in held) and len(held) == 120
    for bank in (None, "A", "B"):
        assert sum(r.is_holdout for r in held if r.bank_id == bank) == 10
    dealt = shards.label_skew_shards(df, {0: [0.5, 0.5], 1: [0.9, 0.1]}, 1).collect()
    assert len(dealt) == 120 and all(r.shard in (0, 1) for r in dealt)
    for label, sizes in ((None, 15), (0, 15), (1, 27), (5, 15)):
        assert sum(r.shard == 0 for r in dealt if r.label == label) == sizes
    capped = shards.cap_keeping_positives(df, 50, 1)
    assert capped.count() == 120 and capped.filter("label = 1").count() == 30
    with pytest.raises(ValueError, match="no bank"):
        shards.bank_sizes(df)


def test_many_groups(spark):
    """More groups than an expression lists."""
    df = spark.range(3_000).select((F.col("id") % 301).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    found = RankFinder(df, ["v"], group="g", fetch_rows=4).keys_at({g: [1, 5] for g in range(301)})
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.v)
    assert found == {(g, k): (sorted(v)[k - 1],) for g, v in rows.items() for k in (1, 5)}
