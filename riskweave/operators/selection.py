"""Exact keys at given ranks, without sorting the table.

Splitting a table into ordered blocks, keeping the first N rows or giving each bank its first N
slots all need one thing: the sort key of the row at a rank. The keys are written once as a narrow table, which
is then read three times: for counts and a quantile sketch of each group, for exact counts of the rows
below and between the sketched bounds of each rank, and for the rows between them, which are few. Those
are fetched, or, if there are still too many, searched again in the same way. The rows themselves are then split
by comparison with the key found, in a plain projection.

Keys are compared as sequences of numbers (`digits`), so whole and real numbers, booleans, dates, TIMESTAMP_NTZ
and text may be mixed, with NULL before all values and NaN after all numbers, as Spark sorts. Rows that tie in the
whole key and lie on both sides of a rank are an error for `RankFinder`, whatever their number; `cuts`
orders them further by a hash of the row, and rows equal in every column by their place in the table.
"""

import math
import os
from collections.abc import Callable, Hashable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import timecols
from riskweave.operators.barrier import computed_once
from riskweave.sources.shared import stored

# Rows of a rank's range that are fetched and finished on the driver.
FETCH_ROWS = 10_000
# Groups (banks, labels) are a small dimension; their counts and sketches are collected.
MAX_GROUPS = 100_000
# Quantiles of a group's sketch, and its accuracy: ranks are off by at most one in so many rows.
_GRID = 500
_ACCURACY = 5_000
# Text is compared by so many bytes at a time.
_CHARS = 6
_LOWEST = float(-(1 << 53))


class TiedKeys(ValueError):
    """Rows with the same key lie on both sides of a rank."""


def _number(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(_LOWEST))


@dataclass(frozen=True)
class _Part:
    """A sort column's share of the digits: `count` from `first` on, each a column of non-null doubles."""

    name: str
    first: int
    count: int
    text: bool
    digit: Callable[[int], Column]


def _plan(order: list[str], kinds: dict[str, T.DataType], longest: dict[str, int]) -> list[_Part]:
    """Digits that order values as Spark does, the first deciding. Text has as many as its longest value needs."""
    parts: list[_Part] = []
    for name in order:
        kind, first = kinds[name], sum(p.count for p in parts)
        if isinstance(kind, T.StringType):
            count = longest[name] // _CHARS + 1
            parts.append(_Part(name, first, count, True, lambda k, c=F.col(name): _text_digit(c, k)))
        else:
            made = _number_digits(name, kind)
            parts.append(_Part(name, first, len(made), False, made.__getitem__))
    return parts


def _number_digits(name: str, kind: T.DataType) -> list[Column]:
    c = F.col(name)
    if isinstance(kind, T.LongType):
        return [_number(F.shiftright(c, 32)), _number(c.bitwiseAND(F.lit((1 << 32) - 1)))]
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [_number(c)]
    if isinstance(kind, T.DateType):
        return [_number(F.unix_date(c))]
    if isinstance(kind, T.TimestampNTZType):
        return [_number(timecols.micros(c))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        number, infinite = c.cast("double"), F.lit(math.inf)
        odd = F.isnan(number) | (F.abs(number) == infinite)
        rank = (
            F.when(c.isNull(), 0.0).when(F.isnan(number), 4.0).when(number == infinite, 3.0).when(number == -infinite, 1.0)
        )
        # Adding zero makes -0.0 and 0.0 one value.
        return [rank.otherwise(2.0), F.when(c.isNull() | odd, 0.0).otherwise(number + 0.0)]
    raise TypeError(f"{name}: {kind.simpleString()} columns have no sort key")


def _text_digit(c: Column, k: int) -> Column:
    """Bytes `k * _CHARS` onwards as a number; a text that ends earlier comes first."""
    part = F.hex(F.substring(c.cast("binary"), k * _CHARS + 1, _CHARS))
    padded = F.conv(F.rpad(part, 2 * _CHARS, "0"), 16, 10).cast("double")
    return F.coalesce(padded * 8 + F.length(part) / 2, F.lit(_LOWEST))


@dataclass
class _Search:
    """Ranges still searched, in one table: rows of `rows` have the range's number in `__node`."""

    rows: DataFrame
    counts: dict[int, int]
    grids: dict[int, list[float]]
    # node -> digit compared there, and ranks asked for -> rank inside
    at: dict[int, int]
    wanted: dict[int, dict[tuple, int]]


def _few(entries: int) -> bool:
    """Few enough to stand in an expression; more come as a table. Results are equal."""
    return entries <= 200


def _marked(
    df: DataFrame, columns: list[tuple[Column, T.DataType]], into: str, kind: T.DataType, marks: dict[tuple, int]
) -> DataFrame:
    """Rows whose columns have one of the listed values (NULL included), with its mark as `into`."""
    if _few(len(marks)):
        mark = F.lit(None).cast(kind)
        for values, number in marks.items():
            same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.lit(v)) for (c, _), v in zip(columns, values, strict=True)))
            mark = F.when(same, number).otherwise(mark)
        return computed_once(df.withColumn(into, mark), "sort-marks").filter(F.col(into).isNotNull())
    fields = [T.StructField(f"__v{i}", t) for i, (_, t) in enumerate(columns)]
    rows = [(*values, number) for values, number in marks.items()]
    # As many rows as groups, or as ranks asked for.
    table = df.sparkSession.createDataFrame(rows, T.StructType([*fields, T.StructField(into, kind)]))
    same = [c.eqNullSafe(F.col(f.name)) for (c, _), f in zip(columns, fields, strict=True)]
    return df.join(F.broadcast(table), same).drop(*(f.name for f in fields))


def _bins(edges: dict[int, list[float]]) -> Column:
    """How many of its node's edges a row's digit has reached."""
    found = F.lit(None).cast("int")
    for node, steps in edges.items():
        reached = reduce(lambda a, b: a + b, ((F.col("__digit") >= F.lit(e)).cast("int") for e in steps))
        found = F.when(F.col("__node") == node, reached).otherwise(found)
    return found


def _joined_bins(placed: DataFrame, edges: dict[int, list[float]]) -> DataFrame:
    table = placed.sparkSession.createDataFrame(list(edges.items()), "__node int, __edges array<double>")
    # As many rows as groups.
    joined = placed.join(F.broadcast(table), "__node")
    return joined.withColumn("__bin", F.size(F.filter("__edges", lambda e: e <= F.col("__digit")))).drop("__edges")


class RankFinder:
    """Find sort keys by rank in `order` (ascending, NULL first), in each group of `group`."""

    def __init__(
        self,
        df: DataFrame,
        order: list[str],
        group: str | None = None,
        fetch_rows: int = FETCH_ROWS,
    ) -> None:
        self.order, self.fetch_rows = order, fetch_rows
        self.kinds = {f.name: f.dataType for f in df.select(*order).schema}
        _plan(order, self.kinds, dict.fromkeys(order, 0))  # refuses unfit columns at once
        group_column = F.col(group) if group else F.lit(None).cast("string")
        keys = computed_once(df.select(group_column.alias("__g"), *order), "sort-keys")
        self.keys = stored(keys, "sort-keys")
        #: Times that the whole key table was read.
        self.passes = 0
        texts = [n for n in order if isinstance(self.kinds[n], T.StringType)]
        self._parts = _plan(order, self.kinds, dict.fromkeys(texts, 1 << 30))
        found = self._sketch(self.keys.withColumn("__node", F.col("__g")), 0, MAX_GROUPS + 1)
        if len(found) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups")
        self.passes += 1
        self.counts: dict[Hashable, int] = {g: n for g, n, _ in found}
        self._grids = {g: grid for g, _, grid in found}

    def _sketch(self, rows: DataFrame, digit: int, most: int) -> list[tuple]:
        """(node, rows, grid of quantiles) of each node."""
        probabilities = [i / _GRID for i in range(_GRID + 1)]
        grid = F.percentile_approx(self._column(digit), probabilities, _ACCURACY)
        sketched = rows.groupBy("__node").agg(F.count(F.lit(1)).alias("n"), grid.alias("grid")).limit(most)
        return [(r["__node"], r["n"], r["grid"]) for r in sketched.collect()]

    def keys_at(self, ranks: dict[Hashable, list[int]]) -> dict[tuple[Hashable, int], tuple]:
        """Key at each 1-based rank of each group. Ranks outside 1..count are left out."""
        asked = {g: [r for r in sorted(set(rs)) if 1 <= r <= self.counts.get(g, 0)] for g, rs in ranks.items()}
        groups = [g for g, rs in asked.items() if rs]
        if not groups:
            return {}
        kind = self.keys.schema["__g"].dataType
        numbered = _marked(self.keys, [(F.col("__g"), kind)], "__node", T.IntegerType(), {(g,): i for i, g in enumerate(groups)})
        search = _Search(
            numbered,
            {i: self.counts[g] for i, g in enumerate(groups)},
            {i: self._grids[g] for i, g in enumerate(groups)},
            {i: 0 for i in range(len(groups))},
            {i: {(g, r): r for r in asked[g]} for i, g in enumerate(groups)},
        )
        found: dict[tuple[Hashable, int], tuple] = {}
        whole = True
        while search.wanted:
            search = self._narrow(search, found)
            self.passes += 2 if whole else 0
            whole = False
        return found

    def _bounds(self, grid: list[float], n: int, ranks: list[int]) -> list[float]:
        """Edges around the ranks: the quantiles below and above each by more than the sketch's error. Both
        values get bins of their own, so a range of few values, or one crowded value, is always divided."""
        edges = set()
        for rank in ranks:
            share = rank / n * _GRID
            for value in (grid[max(math.floor(share) - 1, 0)], grid[min(math.ceil(share) + 1, _GRID)]):
                edges |= {value, math.nextafter(value, math.inf)}
        return sorted(edges)

    def _part(self, digit: int) -> _Part | None:
        """The sort column that a digit belongs to; None after the last."""
        return next((p for p in self._parts if digit < p.first + p.count), None)

    def _column(self, digit: int) -> Column:
        part = self._part(digit)
        return part.digit(digit - part.first)

    def _per_node(self, at: dict[int, int], column: Callable[[int], Column]) -> Column:
        by_digit: dict[int, list[int]] = {}
        for node, digit in at.items():
            by_digit.setdefault(digit, []).append(node)
        return F.coalesce(*(F.when(F.col("__node").isin(nodes), column(d)) for d, nodes in by_digit.items()))

    def _text(self, digit: int) -> Column:
        part = self._part(digit)
        return F.col(part.name) if part.text else F.lit(None).cast("string")

    def _next_digit(self, at: int, bin_: Row) -> int:
        """Where the rows of a bin may differ next: bytes that all its texts share are passed over."""
        part = self._part(at)
        single = bin_["lo"] == bin_["hi"]
        if not part.text:
            return at + single
        first, last = bin_["first"], bin_["last"]
        if first == last and (first is not None or single) and not (first is not None and bin_["lo"] == _LOWEST):
            return part.first + part.count
        if first is None or bin_["lo"] == _LOWEST:
            return at
        shared = os.path.commonprefix([first.encode(), last.encode()])
        return max(at + single, part.first + len(shared) // _CHARS)

    def _narrow(self, search: _Search, found: dict) -> _Search:
        """Count exactly between the edges, then fetch the rows between those of each rank, or sketch them."""
        edges = {
            node: self._bounds(search.grids[node], search.counts[node], list(wanted.values()))
            for node, wanted in search.wanted.items()
        }
        placed = search.rows.withColumn("__digit", self._per_node(search.at, self._column))
        # Filters and comparisons that follow would repeat the expressions of both columns.
        placed = computed_once(placed, "sort-digits")
        placed = placed.withColumn("__bin", _bins(edges)) if _few(sum(map(len, edges.values()))) else _joined_bins(placed, edges)
        placed = computed_once(placed, "sort-bins")
        text = self._per_node(search.at, self._text)
        ends = [F.count(F.lit(1)).alias("n"), F.min("__digit").alias("lo"), F.max("__digit").alias("hi")]
        ends += [F.min(text).alias("first"), F.max(text).alias("last")]
        bins: dict[int, list] = {}
        for r in placed.groupBy("__node", "__bin").agg(*ends).collect():  # a few bins per rank
            bins.setdefault(r["__node"], []).append(r)
        chosen, wanted_of, at_of, rows_of = [], {}, {}, {}
        for node, parts in bins.items():
            before = 0
            for part in sorted(parts, key=lambda p: p["__bin"]):
                inside = {k: r - before for k, r in search.wanted[node].items() if before < r <= before + part["n"]}
                before += part["n"]
                if inside:
                    child = len(chosen)
                    chosen.append((node, part["__bin"], child))
                    wanted_of[child], rows_of[child] = inside, part["n"]
                    at_of[child] = self._next_digit(search.at[node], part)
        of_bin = {(node, bin_): child for node, bin_, child in chosen}
        columns = [(F.col("__node"), T.IntegerType()), (F.col("__bin"), T.IntegerType())]
        inner = _marked(placed, columns, "__child", T.IntegerType(), of_bin).drop("__node", "__bin", "__digit")
        inner = inner.withColumnRenamed("__child", "__node")
        return self._finish(inner, wanted_of, at_of, rows_of, found)

    def _finish(
        self, inner: DataFrame, wanted: dict[int, dict], at: dict[int, int], rows: dict[int, int], found: dict
    ) -> _Search:
        ended = [c for c in rows if self._part(at[c]) is None]
        large = [c for c, n in rows.items() if n > self.fetch_rows and c not in ended]
        if large:
            inner = stored(inner, "sort-keys-near")
        few = [c for c in rows if c not in large and c not in ended]
        # A single key, whatever its number of rows: a rank within it divides equal rows.
        for child in ended:
            if any(rank != rows[child] for rank in wanted[child].values()):
                raise TiedKeys(f"{rows[child]} rows share a sort key")
        if few or ended:
            keys = inner.filter(F.col("__node").isin(few)).select("__node", *self.order) if few else None
            alike = inner.filter(F.col("__node").isin(ended)).select("__node", *self.order).dropDuplicates(["__node"]) if ended else None
            parts = [p for p in (keys, alike) if p is not None]
            fetched: dict[int, list[tuple]] = {c: [] for c in (*few, *ended)}
            for r in reduce(DataFrame.unionAll, parts).collect():
                fetched[r[0]].append(tuple(r[1:]))
            for child, keys in fetched.items():
                keys.sort(key=self._sort_key)
                for asked, rank in wanted[child].items():
                    at_rank = keys[min(rank, len(keys)) - 1]
                    if rank < len(keys) and self._sort_key(keys[rank]) == self._sort_key(at_rank):
                        raise TiedKeys(f"rows share the sort key {at_rank}")
                    found[asked] = at_rank
        sketches = {}
        for digit in {at[c] for c in large}:
            nodes = [c for c in large if at[c] == digit]
            part = inner.filter(F.col("__node").isin(nodes))
            sketches |= {node: grid for node, _, grid in self._sketch(part, digit, len(nodes))}
        keep = {c: rows[c] for c in large}
        return _Search(
            inner.filter(F.col("__node").isin(large)), keep, sketches, {c: at[c] for c in large}, {c: wanted[c] for c in large}
        )

    def _sort_key(self, key: tuple) -> tuple:
        return tuple(_comparable(v) for v in key)


def _comparable(value: object) -> tuple:
    """Python's order of what Spark returned, as Spark orders it."""
    if value is None:
        return (0,)
    if isinstance(value, float):
        return (2,) if math.isnan(value) else (1, value + 0.0)
    return (1, value.encode()) if isinstance(value, str) else (1, value)


def _literal(value: object) -> Column:
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value.isoformat()).cast("date") if isinstance(value, date) and not isinstance(value, datetime) else F.lit(value)


def at_or_before(order: list[str], key: tuple) -> Column:
    """TRUE where the row's sort key is not after `key` (lexicographic, NULL first); never NULL."""
    condition = F.lit(True)
    for name, value in reversed(list(zip(order, key, strict=True))):
        column = F.col(name)
        if value is None:
            condition = column.isNull() & condition
        else:
            less = F.coalesce(column < _literal(value), F.lit(True))
            condition = less | (column.eqNullSafe(_literal(value)) & condition)
    return condition


ROW_HASH, ROW_PLACE = "__row_hash", "__row_place"
Ranks = Callable[[dict[Hashable, int]], dict[Hashable, list[int]]]


@dataclass(frozen=True)
class Cuts:
    """Keys at ranks of `df`, in `order`. `df` and `order` are those given, with columns added where ties had
    to be broken."""

    df: DataFrame
    order: list[str]
    keys: dict[tuple[Hashable, int], tuple]
    counts: dict[Hashable, int]
    added: tuple[str, ...] = ()

    def key(self, rank: int, group: Hashable = None) -> tuple | None:
        return self.keys.get((group, rank))

    def until(self, key: tuple) -> Column:
        return at_or_before(self.order, key)


def cuts(
    df: DataFrame, order: list[str], ranks: Ranks, group: str | None = None, fetch_rows: int = FETCH_ROWS
) -> Cuts:
    """Keys at the ranks that `ranks` names for the rows counted in each group. The order need not be
    total: rows that tie around a rank are ordered by a hash of all their columns, and rows that are equal
    throughout by their place in the table, which has to be a stored one for that."""
    place = F.monotonically_increasing_id()
    hashed = F.xxhash64(*(c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)))
    for added in ({}, {ROW_HASH: hashed, ROW_PLACE: place}):
        keyed = df.withColumns(added) if added else df
        finder = RankFinder(keyed, [*order, *added], group, fetch_rows)
        try:
            found = finder.keys_at(ranks(finder.counts))
        except TiedKeys:
            continue
        return Cuts(keyed, [*order, *added], found, finder.counts, tuple(added))
    raise AssertionError("places in a table are unique")
