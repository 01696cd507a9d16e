"""Exact dedup (2), SimHash (8), sharding (10): against brute force and SQL."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from compare import connect, difference
from pyspark.sql import functions as F

from riskweave.llm import components, exact_dedup, queries, sharding, simhash_trie
from riskweave.llm.common import stored


def deduped(docs, **kwargs):
    keyed = docs.withColumn("key", exact_dedup.text_key())
    return exact_dedup.exact_dedup(keyed, "key", "doc_id", **kwargs)


def test_op2_equals_sql(spark, sf_dir):
    con = connect(sf_dir)
    assert difference(spark, con, queries.op2_exact_dedup, queries.ORACLES["op2_exact_dedup"], sf_dir) is None


def test_dedup_edges(edge_docs, no_docs):
    rows = deduped(edge_docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r)
    assert len(rows) == edge_docs.count()
    for own in groups.values():
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        kept = [r for r in own if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == (max(ids) if ids else None)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(max(ids) if ids else None, len(own))}
    assert len({c for c in deduped(edge_docs).columns}) == len(edge_docs.columns) + 2  # kept, keep_id replaced
    assert deduped(no_docs).count() == 0


def test_dedup_with_several_filters_and_a_hot_group(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise((F.col("id") % 9000).cast("string")).alias("text")
    )
    one, many = (sorted(map(tuple, deduped(rows, max_filter_bytes=m).collect())) for m in (1 << 26, 1 << 18))
    assert one == many
    groups = {}
    for key, text, *_ in one:
        groups.setdefault(text, []).append(key)
    assert all(keep == max(groups[t]) and n == len(groups[t]) and kept == (i == keep) for i, t, _, keep, n, kept in one)


@pytest.mark.parametrize("blocks", [1, 4])
def test_bloom_blocks_find_every_repeat(blocks):
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**62), 2**62, 5000)
    parts = [hashes[:3000], hashes[2900:], hashes[:0]]

    def batch(x):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x)], names=["h"])

    rows = [r for p in parts for r in exact_dedup.touched_blocks(blocks)(iter([batch(p)]))]
    (merged,) = exact_dedup.merged_blocks(iter(rows))
    bits = bytearray(blocks * 4096)
    for block, twice in zip(*(c.to_pylist() for c in merged.columns), strict=True):
        bits[block * 4096 : (block + 1) * 4096] = twice
    table = np.frombuffer(bytes(bits), dtype=np.uint8)
    at = exact_dedup.slots(hashes, blocks)
    hit = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
    assert hit[2900:3000].all() and (blocks == 1 or hit.mean() < 0.6)


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint) -> component of each row."""
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [least.get(top(i)) for i in range(len(rows))]


def test_op8_equals_brute_force(spark, sf_dir, documents):
    rows = [(key, plain_fingerprint(text)) for key, text in documents]
    expected = {(k, f"{f:016x}", c) for (k, f), c in zip(rows, plain_components(rows), strict=True)}
    assert set(map(tuple, queries.op8_simhash_trie(spark, sf_dir).collect())) == expected


def test_simhash_edges(edge_docs, no_docs):
    got = simhash_trie.simhash_groups(edge_docs).collect()
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in edge_docs.collect()]
    expected = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(rows, plain_components(rows), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == expected
    assert simhash_trie.simhash_groups(no_docs).count() == 0
    kept = simhash_trie.one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in expected}, key=str)
    assert simhash_trie.one_of_each_group(no_docs).count() == 0


def clustered(n, seed):
    rng = random.Random(seed)
    out = {0, 2**64 - 1}
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("block", [64, 400_000])
def test_trie_walk_finds_every_pair(monkeypatch, block):
    monkeypatch.setattr(simhash_trie, "BLOCK", block)
    values = clustered(700, 1)
    a = np.array(values, dtype=np.uint64)
    want = {(i, j) for j in range(len(a)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 3}
    got = [(int(i), int(j)) for x, y in simhash_trie.linked_pairs(a, a, True) for i, j in zip(x, y, strict=True)]
    assert set(got) == want and len(got) == len(want)
    half = len(a) // 2
    across = {(int(i), int(j)) for x, y in simhash_trie.linked_pairs(a[:half], a[half:], False) for i, j in zip(x, y, strict=True)}
    assert across == {(i, j - half) for i, j in want if i < half <= j}


@pytest.mark.parametrize("spread,job_rows,step", [(64, 2_000_000, 12), (500, 40, 5)])
def test_near_groups_over_many_jobs(spark, monkeypatch, spread, job_rows, step):
    monkeypatch.setattr(simhash_trie, "SPREAD", spread)
    monkeypatch.setattr(simhash_trie, "JOB_ROWS", job_rows)
    monkeypatch.setattr(simhash_trie, "STEP", step)
    values = clustered(900, 2)
    rows = [(i, v) for i, v in enumerate(values)]
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in rows]
    df = stored(spark.createDataFrame(signed, "doc_id long, fp long"), "t")
    got = {r["doc_id"]: r["component_id"] for r in simhash_trie.near_groups(df).collect()}
    assert [got[i] for i, _ in rows] == plain_components(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    df = spark.createDataFrame([*chain, *star, (5000, 5000), (-7, 3000)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 400)}, 3000: -7}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Sharding


def least_capacity(sizes, shards):
    low, high = 0, sum(sizes)

    def fits(capacity):
        used, left = 0, -1
        for s in sizes:
            if s > capacity:
                return False
            if s > left:
                used, left = used + 1, capacity
            left -= s
        return used <= shards

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("fanout", [2, 7, 4096])
def test_cuts_are_minimax(spark, monkeypatch, fanout):
    monkeypatch.setattr(sharding, "FANOUT", fanout)
    rng = random.Random(fanout)
    for shards, n in ((1, 5), (3, 2), (8, 120)):
        sizes = [rng.choice([1, 5, 60, 400]) for _ in range(n)]
        if n == 120:
            sizes[70] = 9000  # a group over its share
        through = np.cumsum(sizes).tolist()
        df = spark.createDataFrame([(x,) for x in through], "through long").coalesce(1).cache()
        ends = [0, *sharding.cuts(df, through[-1], shards), through[-1]]
        assert all(e in (0, *through) for e in ends) and ends == sorted(ends)
        assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) == least_capacity(sizes, shards)


def check_shards(rows, shards):
    groups = {}
    for r in rows:
        groups.setdefault(r["text_key"], []).append(r)
        assert 0 <= r["shard"] < shards
    assert all(len({r["shard"] for r in own}) == 1 for own in groups.values())

    def place(own):
        least = min((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)
        return least is not None, least or 0, bytes(own[0]["text_key"])

    ordered = sorted(groups.values(), key=place)
    assert [own[0]["shard"] for own in ordered] == sorted(own[0]["shard"] for own in ordered)
    held = [[r for r in rows if r["shard"] == s] for s in range(shards)]
    assert max(sum(r["size"] for r in own) for own in held) == least_capacity([sum(r["size"] for r in g) for g in ordered], shards)
    for own in held:
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_op10_is_minimax_with_gapless_slots(spark, sf_dir, documents):
    rows = sharding.shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8).collect()
    check_shards(rows, 8)
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes == {key: len((text or "").encode()) + 1 for key, text in documents}
    got = queries.op10_sharding(spark, sf_dir).collect()
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    texts = dict(documents)
    assert all(hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["text_sha256"] for r in got)


def test_sharding_edges(edge_docs, no_docs):
    rows = sharding.shard_by_bytes(edge_docs, 3).collect()
    assert len(rows) == edge_docs.count()
    check_shards(rows, 3)
    assert sharding.shard_by_bytes(no_docs, 3).count() == 0
    with_shard = sharding.with_shards(edge_docs, 3)
    assert set(with_shard.columns) == {*edge_docs.columns, "shard"} and with_shard.count() == len(rows)


def test_pairs_compared_together_are_bounded(monkeypatch):
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64(0xFFF0000000000F0F))
    near = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist() if i < j}
    sizes, expanded = [], simhash_trie.expanded
    monkeypatch.setattr(simhash_trie, "expanded", lambda *nodes: sizes.append(len(nodes[0])) or expanded(*nodes))
    monkeypatch.setattr(simhash_trie, "TOGETHER", 100)
    found = [(i, j) for a, b in simhash_trie.linked_pairs(fps, fps, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(found) == sorted(near) and near and max(sizes) <= 100


def test_workers_are_freed_before_links_are_joined(spark, monkeypatch):
    steps = []
    components, free = simhash_trie.components, simhash_trie.free_workers
    monkeypatch.setattr(simhash_trie, "components", lambda edges: steps.append("components") or components(edges))
    monkeypatch.setattr(simhash_trie, "free_workers", lambda spark: steps.append("free") or free(spark))
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "other words")], "doc_id long, text string")
    assert simhash_trie.one_of_each_group(docs).count() == 2 and steps == ["free", "components"]
