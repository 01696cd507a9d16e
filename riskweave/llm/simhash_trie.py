"""SimHash near-duplicates (operator 8) by a self-join of the binary trie of fingerprints.

The trie of all distinct 64-bit fingerprints is walked in pairs of nodes. A pair carries the number of
bits that differ on its two paths; a pair over the budget is dropped with everything below it.

The upper part of the walk is planned on the driver from prefix counts: the trie is cut into at most
about 16,000 subtries of similar size (bounded by `LEAVES`), and the pairs of subtries that are within
the budget become jobs. A job holds one subtrie and a block of its partners, and walks on down to the
fingerprints with numpy, a bounded block of node pairs at a time. It joins what it links and returns a
spanning forest, never all pairs of a group. Components over all jobs follow from `components`.

Copies share a fingerprint and are one node. Texts without words have fingerprint zero. A null text is
empty. `component_id` ignores null ids and is null where a component has no other. Repeated rows each
get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import free_workers, fresh_name, join_by_group, stored
from riskweave.llm.components import components

BITS = 64
BUDGET = 3
SEED = 42
SHINGLE = 3
#: Least number of subtries (small inputs still spread), their size beyond that, and the most.
SPREAD, SUBTRIE, LEAVES = 64, 100_000, 8192
#: Fingerprints of a job's partners, at most about.
JOB_ROWS = 2_000_000
#: Node pairs taken at a time, the number of fingerprint pairs below which nodes are compared whole, and how
#: many node pairs are so compared together: at most 16 times as many fingerprint pairs, about 50 MB.
BLOCK, SMALL, TOGETHER = 400_000, 16, 50_000
STEP = 12  # prefix bits that one count of the plan adds

BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
BYTE_OFFSETS = np.arange(8) * 256


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the unsigned 64-bit hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8) + BYTE_OFFSETS
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BIT_TABLE).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # both steps on bytes: ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return majority(np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64))


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column `text` by `fp`, the fingerprint as a signed long."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(at)], dtype=np.uint64).view(np.int64)
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], names=[*names, "fp"])


# The walk


def linked_pairs(a: np.ndarray, b: np.ndarray, itself: bool, budget: int = BUDGET):
    """Index pairs (i, j) of the sorted unsigned fingerprints with at most `budget` differing bits, a
    block at a time. `itself`: a is b, and each pair comes once, i < j."""
    if not len(a) or not len(b):
        return
    root = tuple(np.array([x]) for x in (0, len(a), 0, len(b), 0))
    stack = [(0, root)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > BLOCK:
            half = len(pairs[0]) // 2
            stack += [(depth, tuple(x[:half] for x in pairs)), (depth, tuple(x[half:] for x in pairs))]
            continue
        alo, ahi, blo, bhi, diff = pairs
        small = (ahi - alo) * (bhi - blo) <= SMALL
        few = np.flatnonzero(small)
        for at in range(0, len(few), TOGETHER):
            i, j = expanded(*(x[few[at : at + TOGETHER]] for x in pairs[:4]))
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if itself:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if not small.all():
            big = ~small
            below = children(a, b, depth, *(x[big] for x in pairs), budget, itself)
            if len(below[0]):
                stack.append((depth + 1, below))


def expanded(alo, ahi, blo, bhi):
    """All index pairs of each node pair."""
    width = bhi - blo
    each = (ahi - alo) * width
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    w = np.repeat(width, each)
    return np.repeat(alo, each) + k // w, np.repeat(blo, each) + k % w


def middle(values: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at `depth` turns to one in the nodes that begin at `low`."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    above = np.uint64(0) if depth == 0 else ~((bit << np.uint64(1)) - np.uint64(1))
    return np.searchsorted(values, (values[low] & above) | bit)


def children(a, b, depth, alo, ahi, blo, bhi, diff, budget, itself):
    am, bm = middle(a, alo, depth), middle(b, blo, depth)
    sides = ((alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), (am, ahi, blo, bm, diff + 1))
    out = [np.concatenate(x) for x in zip(*sides, strict=True)]
    keep = (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= budget)
    if itself:
        keep &= out[0] <= out[2]
    return tuple(x[keep] for x in out)


class Forest:
    """Union-find over index arrays; each root is the smallest index of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.parent[i], self.parent[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(self.parent, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


# The plan


OWN, PARTNER, OWN_SELF = 0, 1, 2


def subtries(fps: DataFrame, total: int) -> list[tuple[int, int, int]]:
    """(prefix, depth, rows) of subtries that cover all fingerprints."""
    most = max(min(-(-total // SPREAD), SUBTRIE), -(-total // LEAVES))
    out, heavy, depth = [], None, 0
    while depth < BITS:
        step = min(STEP, BITS - depth)
        top = F.shiftrightunsigned("fp", BITS - depth - step)
        part = fps
        if heavy is not None:  # at most total / most prefixes
            names = fps.sparkSession.createDataFrame([(p,) for p in heavy], "prefix long")
            part = fps.join(F.broadcast(names), F.shiftrightunsigned("fp", BITS - depth) == F.col("prefix"))
        counts = {r["p"]: r["count"] for r in part.groupBy(top.alias("p")).count().collect()}
        level = counts if depth + step < BITS else {p & ((1 << BITS) - 1): n for p, n in counts.items()}
        depth += step
        # Merge upwards while two siblings fit into one subtrie.
        at, floor = depth, depth - step
        heavy = [p for p, n in level.items() if n > most]
        level = {p: n for p, n in level.items() if n <= most}
        blocked = set(heavy)
        while at > floor and level:
            merged: dict[int, int] = {}
            stay = {}
            for p, n in level.items():
                if (p ^ 1) in blocked or n + level.get(p ^ 1, 0) > most:
                    stay[p] = n
                else:
                    merged[p >> 1] = n + level.get(p ^ 1, 0)
            out += [(p, at, n) for p, n in stay.items()]
            blocked = {p >> 1 for p in (*blocked, *stay)}
            level, at = {p: n for p, n in merged.items() if p not in blocked}, at - 1
        out += [(p, at, n) for p, n in level.items()]
        if not heavy:
            break
    return out


def near_subtries(leaves: list[tuple[int, int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs (i, j), i <= j, of subtries that may hold fingerprints within the budget."""
    tree: dict = {}
    for k, (prefix, depth, _) in enumerate(leaves):
        node = tree
        for d in range(depth - 1, -1, -1):
            node = node.setdefault(prefix >> d & 1, {})
        node["leaf"] = k
    out, stack = [], [(tree, tree, 0)]
    while stack:
        x, y, diff = stack.pop()
        if "leaf" in x and "leaf" in y:
            i, j = x["leaf"], y["leaf"]
            if i <= j:
                out.append((i, j))
        elif "leaf" in x:
            stack += [(x, y[d], diff) for d in (0, 1) if d in y]
        elif "leaf" in y:
            stack += [(x[d], y, diff) for d in (0, 1) if d in x]
        else:
            stack += [(x[d], y[e], diff + (d != e)) for d in (0, 1) if d in x for e in (0, 1) if e in y and diff + (d != e) <= budget]
    return out


def plan(fps: DataFrame, total: int, budget: int) -> tuple[np.ndarray, ...]:
    """(starts, edges, jobs, roles). `starts`: first fingerprint of each subtrie, sorted. For subtrie k,
    the entries `edges[k] : edges[k + 1]` of `jobs` and `roles` say where its fingerprints go."""
    leaves = sorted(subtries(fps, total), key=lambda x: x[0] << (BITS - x[1]))
    partners: dict[int, list[int]] = {i: [] for i in range(len(leaves))}
    for i, j in near_subtries(leaves, budget):
        if i != j:
            partners[i].append(j)
    entries, job = [], 0
    for i in range(len(leaves)):
        entries.append((i, job, OWN_SELF))
        held = 0
        for j in sorted(partners[i]):
            if held and held + leaves[j][2] > JOB_ROWS:
                job, held = job + 1, 0
                entries.append((i, job, OWN))
            entries.append((j, job, PARTNER))
            held += leaves[j][2]
        job += 1
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 3)
    starts = np.array([p << (BITS - d) for p, d, _ in leaves], dtype=np.uint64)
    return starts, np.searchsorted(table[:, 0], np.arange(len(leaves) + 1)), table[:, 1], table[:, 2]


def links(fps: DataFrame, total: int, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect all within the budget."""
    planned = fps.sparkSession.sparkContext.broadcast(plan(fps, total, budget))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, edges, to, roles = planned.value
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            leaf = np.searchsorted(starts, own, side="right") - 1
            for at in range(0, len(own), 4096):  # a fingerprint goes to several hundred jobs at most
                part = leaf[at : at + 4096]
                first, each = edges[part], edges[part + 1] - edges[part]
                k = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
                columns = (to[k], roles[k].astype(np.int32), np.repeat(own[at : at + 4096].view(np.int64), each))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["job", "role", "fp"])

    def walked(rows: pa.Table) -> pa.Table:
        role = rows.column("role").to_numpy()
        fp = rows.column("fp").to_numpy().view(np.uint64)
        own, partner = np.sort(fp[role != PARTNER]), np.sort(fp[role == PARTNER])
        forest = Forest(len(own) + len(partner))
        if (role == OWN_SELF).any():
            for i, j in linked_pairs(own, own, True, budget):
                forest.unite(i, j)
        for i, j in linked_pairs(own, partner, False, budget):
            forest.unite(i, j + len(own))
        both = np.concatenate([own, partner]).view(np.int64)
        under = np.flatnonzero(forest.parent != np.arange(len(both)))
        return pa.table({"a": both[under], "b": both[forest.parent[under]]})

    jobs = fps.select("fp").mapInArrow(dealt, "job long, role int, fp long")
    return jobs.groupBy("job").applyInArrow(walked, "a long, b long")


def near_groups(rows: DataFrame, id_col: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """Stored rows with a fingerprint `fp` -> the same rows with `component_id`."""
    total = rows.count()
    fps = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("n")), "fingerprints")
    edges = stored(links(fps, fps.count(), budget), "links")
    free_workers(rows.sparkSession)  # from here on the work is in the JVM, which then takes the memory
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = stored(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component"), "roots")
    groups = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = join_by_group(rooted, stored(groups, "groups"), "root", "members", fps.count())
    named = stored(named.select("fp", "n", "component_id"), "named")
    return join_by_group(rows, named, "fp", "n", total).drop("n")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, small: int = 1_000_000
) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays (a
    null id is the largest; of rows that tie, one). Columns are kept as they are."""
    # Rows are numbered and stored once, so that a number means the same row ever after.
    row = fresh_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    read = numbered.select(F.col(row).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    rows = stored(read.mapInArrow(fingerprints, "__row long, __id long, fp long"), "simhash")
    grouped = stored(near_groups(rows, "__row", budget), "grouped")
    head = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__row")).alias("head")
    heads = grouped.groupBy("component_id").agg(head).select(F.col("head.__row").alias("__row"), F.lit(True).alias("stays"))
    dropped = stored(grouped.select("__row").join(heads, "__row", "left").where("stays IS NULL").select(F.col("__row").alias(row)), "dropped")
    # Few rows to drop are broadcast; many are shuffled, by a number that no two rows share.
    few = F.broadcast(dropped) if dropped.count() <= small else dropped
    return numbered.join(few, row, "left_anti").drop(row)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per document: `doc_id`, `fingerprint` (16 hex digits) and `component_id`."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(read.mapInArrow(fingerprints, "doc_id long, fp long"), "simhash")
    grouped = near_groups(rows, "doc_id", budget)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
