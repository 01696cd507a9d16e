"""Sharding (operator 10): minimax contiguous partition of ordered atomic groups.

Documents of equal text are one group, which no shard border may split. Groups are ordered by their
smallest id. The smallest capacity C is searched by bisection for which filling shard after shard
greedily up to C places all groups; no cut into so many contiguous shards has a smaller largest shard.
With C fixed, each cut goes where the remaining bytes would be shared most evenly, as far as C allows.

A check needs the last prefix sum at or below a number. The sums stay in a stored table; the driver
holds a bounded set of them and bounds each answer from both sides. Where the bounds differ, one
aggregation refines those gaps 4,096-fold, so a few small jobs make the search exact at any size.

A null text is empty, with size 1, and equal to an empty text. Null ids come first. Repeated rows are
placed each. No rows give no shards.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import fresh_name, join_by_group, stored
from riskweave.llm.ordered import prefix_sums

FANOUT = 4096


class PrefixPoints:
    """Known prefix sums of a stored table; `through` holds each group's inclusive sum."""

    def __init__(self, through: DataFrame, total: int):
        self.through, self.total = through, total
        self.points = [0, total]
        self.open = [total > 0]  # whether groups may end inside (points[i], points[i + 1])

    def refine(self, gaps: list[int]) -> None:
        """Learn more sums inside the gaps with these numbers, in one job."""
        gaps = [g for g in sorted(set(gaps)) if self.open[g]]
        if not gaps:
            return
        sums = F.col("through")
        bucket = None
        for g in gaps:
            a, b = self.points[g], self.points[g + 1]
            width = max(1, -(-(b - a) // FANOUT))
            inside = (sums > a) & (sums < b)
            made = F.struct(F.lit(g).alias("gap"), F.floor((sums - a - 1) / width).alias("bucket"))
            bucket = F.when(inside, made) if bucket is None else bucket.when(inside, made)
        found = (
            self.through.select("through", bucket.alias("at"))
            .where("at IS NOT NULL")
            .groupBy("at")
            .agg(F.min("through").alias("low"), F.max("through").alias("high"), F.countDistinct("through").alias("n"))
            .collect()  # at most FANOUT rows for each of a few gaps
        )
        inner: dict[int, list] = {g: [] for g in gaps}
        for row in found:
            inner[row["at"]["gap"]].append((row["low"], row["high"], row["n"]))
        points, open_ = [self.points[0]], []
        for g in range(len(self.open)):
            if g not in inner:
                open_.append(self.open[g])
            else:
                for low, high, n in sorted(inner[g]):
                    points.append(low)
                    open_.append(False)
                    if high > low:
                        points.append(high)
                        open_.append(n > 2)
                open_.append(False)
            points.append(self.points[g + 1])
        self.points, self.open = points, open_

    def gap(self, x: int) -> int:
        """Number of the gap that x lies in: points[gap] <= x."""
        return min(bisect_right(self.points, x) - 1, len(self.open) - 1)

    def bounds(self, x: int) -> tuple[int, int]:
        """Smallest and largest possible value of the last sum at or below x."""
        if x >= self.total:
            return self.total, self.total
        g = self.gap(x)
        return self.points[g], x if self.open[g] else self.points[g]

    def around(self, x: int) -> tuple[int, int]:
        """The last sum at or below x, and the first above it."""
        while x < self.total and self.open[self.gap(x)]:
            self.refine([self.gap(x)])
        if x >= self.total:
            return self.total, self.total
        return self.points[self.gap(x)], self.points[self.gap(x) + 1]

    def fits(self, capacity: int, shards: int, side: int) -> bool:
        """Whether the greedy fill needs at most `shards`: surely (side 0) or possibly (side 1)."""
        at = 0
        for _ in range(shards):
            at = self.bounds(at + capacity)[side]
        return at >= self.total

    def least(self, shards: int, side: int) -> int:
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards, side):
                high = middle
            else:
                low = middle + 1
        return low


def smallest_capacity(sums: PrefixPoints, shards: int) -> int:
    """The least capacity for which the greedy fill needs at most `shards`."""
    while True:
        low, high = sums.least(shards, 1), sums.least(shards, 0)
        if low == high:
            return high
        a = b = 0
        gaps: list[int] = []
        for _ in range(shards):
            a, b = sums.bounds(a + low)[0], sums.bounds(b + high)[1]
            touched = range(sums.gap(a), sums.gap(b) + 1)
            gaps += [g for g in touched if sums.open[g]]
        sums.refine(gaps)


def cuts(through: DataFrame, total: int, shards: int) -> list[int]:
    """Prefix sums at which shards 0 .. shards - 2 end: the largest shard is as small as possible."""
    sums = PrefixPoints(through, total)
    capacity = smallest_capacity(sums, shards)
    # The earliest end of each shard that leaves no more than fits behind it: greedy from the right.
    earliest, at = [], total
    for _ in range(shards - 1):
        low, high = sums.around(max(0, at - capacity))
        at = low if low >= at - capacity else high
        at = max(0, at)
        earliest.append(at)
    earliest.reverse()
    out, at = [], 0
    for i in range(shards - 1):
        ideal = at + round((total - at) / (shards - i))
        low, high = sums.around(ideal)
        allowed = [c for c in (low, high) if earliest[i] <= c <= at + capacity and c >= at]
        if not allowed:
            allowed = [earliest[i] if ideal < earliest[i] else sums.around(at + capacity)[0]]
        at = min(allowed, key=lambda c: (abs(c - ideal), c))
        out.append(at)
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
    )


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: `doc_id`, `size`, `text_crc32`, `text_key`, `shard` (0 .. shards - 1) and `slot`
    (its place in the shard, by id). Texts are read once and not shuffled."""
    rows = stored(sized(docs, id_col, text_col), "sized")
    total_rows, total_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = rows.groupBy("text_key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )
    summed = prefix_sums(groups, [F.col("first_id"), F.col("text_key")], ["bytes"], "groups")
    summed = stored(summed.withColumn("through", F.col("bytes_before") + F.col("bytes")), "group-sums")
    ends = cuts(summed.select("through"), total_bytes, shards) if total_rows else [0] * (shards - 1)
    shard = sum((F.when(F.col("through") > e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    placed = summed.select("text_key", "n", shard.alias("shard"))
    joined = join_by_group(rows, placed, "text_key", "n", total_rows).drop("n")
    # Number all rows in (shard, id) order, then count from the first row of each shard.
    order = [F.col("shard"), F.col("doc_id"), F.col("text_key")]
    numbered = prefix_sums(joined.withColumn("one", F.lit(1)), order, ["one"], "shard-rows")
    sizes = dict(placed.groupBy("shard").agg(F.sum("n")).collect())
    firsts = [sum(sizes.get(j, 0) for j in range(i)) for i in range(shards)]
    first = F.element_at(F.array(*map(F.lit, firsts)), F.col("shard") + 1)
    return numbered.select(
        "doc_id", "size", "text_crc32", "text_key", "shard", (F.col("one_before") - first).cast("long").alias("slot")
    )


def with_shards(docs: DataFrame, shards: int = 8, text_col: str = "text", **kwargs) -> DataFrame:
    """The documents themselves with their `shard`, for a write partitioned by it. A document's shard
    follows from its text alone, so the assignment is joined by the text's key."""
    placed = shard_by_bytes(docs, shards, text_col=text_col, **kwargs)
    docs = docs.drop("shard")
    text_key, n = fresh_name(docs, "text_key"), fresh_name(docs, "n")
    by_key = placed.groupBy(F.col("text_key").alias(text_key)).agg(F.first("shard").alias("shard"), F.count(F.lit(1)).alias(n))
    by_key = stored(by_key, "shards")
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = docs.withColumn(text_key, key)
    return join_by_group(keyed, by_key, text_key, n, docs.count()).drop(text_key, n)
