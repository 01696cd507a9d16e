"""Splitting labelled rows into banks, holdouts and capped samples.

Every split is a comparison of a row's sort key with a few keys found by rank, so rows are neither
sorted nor moved. Sort columns may be of any type that has an order, with NULL first; rows that tie are told apart by
a hash of the whole row, and equal rows by their place in the table (`selection.cuts`), so sizes are exact.
"""

from collections.abc import Sequence
from fractions import Fraction
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.selection import FETCH_ROWS, MAX_GROUPS, Cuts, at_or_before, cuts

# Fixed value: names of the first banks.
_FIRST_BANKS = ("BANK-A", "BANK-B", "BANK-C", "BANK-D", "BANK-E")
MIN_SAMPLED_NEGATIVES = 1_000


def shuffle_key(row_id: str, seed: int) -> Column:
    """A reproducible random order: the hash of the seed and the row id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def _block_ranks(rows: int, blocks: int) -> list[int]:
    """Last rank of every block but the last; the first `rows % blocks` blocks get one row more."""
    base, extra = divmod(rows, blocks)
    return [base * (i + 1) + min(i + 1, extra) for i in range(blocks - 1)]


def _block_of(order: list[str], ends: Sequence[tuple | None]) -> Column:
    """Number of block ends a row lies after, by bisection; an end of None precedes all rows."""
    def block(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        if ends[middle] is None:
            return block(middle + 1, last)
        early = at_or_before(order, ends[middle])
        return F.when(early, block(first, middle)).otherwise(block(middle + 1, last))
    return block(0, len(ends))


def _plain(found: Cuts, **added: Column) -> DataFrame:
    """The table of the cuts with columns added, without those that broke ties."""
    return found.df.withColumns(added).drop(*found.added)


def contiguous_shards(
    df: DataFrame, banks: int, order: list[str], fetch_rows: int = FETCH_ROWS
) -> DataFrame:
    """Add `shard` (0..banks-1): near-equal blocks in `order`. Ordered by time this gives temporal
    shards."""
    found = cuts(df, order, lambda n: {None: _block_ranks(n.get(None, 0), banks)}, fetch_rows=fetch_rows)
    ends = [found.key(r) for r in _block_ranks(found.counts.get(None, 0), banks)]
    return _plain(found, shard=_block_of(found.order, ends))


def counts_from_proportions(rows: int, proportions: Sequence[float]) -> list[int]:
    """Whole counts that add up to `rows`: every share is cut to a whole number, and those that lost most
    by it get one back; of equal losses the first."""
    total = sum(map(Fraction, proportions))
    shares = [rows * Fraction(p) / total for p in proportions]
    missing = rows - sum(map(floor, shares))
    lost_most = sorted(range(len(shares)), key=lambda bank: (floor(shares[bank]) - shares[bank], bank))[:missing]
    return [floor(share) + (bank in lost_most) for bank, share in enumerate(shares)]


def label_proportions(banks: int, alpha: float, seed: int) -> dict[int, list[float]]:
    """Dirichlet share of every bank in each label."""
    rng = np.random.default_rng(seed)
    return {label: [float(p) for p in rng.dirichlet([alpha] * banks)] for label in (0, 1)}


def label_skew_shards(
    df: DataFrame,
    proportions: dict[int, list[float]],
    seed: int,
    row_id: str = "id",
    label: str = "label",
    fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    """Add `shard`: the rows of each label are dealt to the banks in the given proportions, in
    random order. Every row gets a shard; a small share may leave a bank empty. Rows without a label, or with
    one that has no proportions, are dealt in equal shares."""
    banks = max(map(len, proportions.values()))

    def ranks(counts: dict) -> dict:
        out = {}
        for value, n in counts.items():
            dealt = counts_from_proportions(n, proportions.get(value, [1.0] * banks))
            out[value] = [int(r) for r in np.cumsum(dealt)[:-1]]
        return out

    keyed = df.withColumn("__h", shuffle_key(row_id, seed))
    found = cuts(keyed, ["__h"], ranks, group=label, fetch_rows=fetch_rows)
    shard = F.lit(None).cast("int")
    for value, asked in ranks(found.counts).items():
        block = _block_of(found.order, [found.key(r, value) for r in asked])
        shard = F.when(F.col(label).eqNullSafe(F.lit(value)), block).otherwise(shard)
    return _plain(found, shard=shard).drop("__h")


def holdout_split(
    df: DataFrame, frac: float, order: list[str], fetch_rows: int = FETCH_ROWS
) -> DataFrame:
    """Add `is_holdout`: the last `frac` of the rows in `order`."""

    def kept(n: dict) -> int:
        return int(n.get(None, 0) * (1.0 - frac))

    found = cuts(df, order, lambda n: {None: [kept(n)]}, fetch_rows=fetch_rows)
    last = found.key(kept(found.counts))
    held = F.lit(True) if last is None else ~found.until(last)
    return _plain(found, is_holdout=held)


def random_holdout(df: DataFrame, frac: float, seed: int, row_id: str = "id") -> DataFrame:
    keyed = df.withColumn("__h", shuffle_key(row_id, seed))
    return holdout_split(keyed, frac, ["__h"]).drop("__h")


def pooled_holdout(
    df: DataFrame,
    frac: float,
    seed: int,
    bank: str = "bank_id",
    row_id: str = "id",
    fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    """Add `is_holdout`: a random `frac` of every bank, at least one row of each. Rows without a bank are
    split as those of one more."""

    def takes(counts: dict) -> dict:
        return {b: [max(1, round(n * frac))] for b, n in counts.items()}

    keyed = df.withColumn("__h", shuffle_key(row_id, seed))
    found = cuts(keyed, ["__h"], takes, group=bank, fetch_rows=fetch_rows)
    names = [f"__last{i}" for i in range(len(found.order))]
    kinds = [found.df.schema[c].dataType.simpleString() for c in found.order]
    rows = [(b, *key) for (b, _), key in found.keys.items()]
    fields = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    # One row per bank, of which `RankFinder` refuses more than it can list.
    ends = df.sparkSession.createDataFrame(rows, f"__bank {df.schema[bank].dataType.simpleString()}, {fields}")
    marked = found.df.join(F.broadcast(ends), F.col(bank).eqNullSafe(F.col("__bank")), "left")
    held = F.lit(True)
    for c, last in reversed(list(zip(found.order, names, strict=True))):
        held = (F.col(c) < F.col(last)) | ((F.col(c) == F.col(last)) & held)
    return marked.withColumn("is_holdout", held).drop("__h", "__bank", *names, *found.added)


def cap_keeping_positives(
    df: DataFrame, max_rows: int, seed: int, row_id: str = "id", label: str = "label"
) -> DataFrame:
    """All positives and a random sample of the negatives. At least 1,000 negatives stay, so the
    result may exceed `max_rows`. Rows of any label but 1 are negatives."""

    def take(counts: dict) -> int:
        return min(max(max_rows - counts.get(True, 0), MIN_SAMPLED_NEGATIVES), counts.get(False, 0))

    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    keyed = df.withColumns({"__h": shuffle_key(row_id, seed), "__positive": positive})
    found = cuts(keyed, ["__h"], lambda n: {False: [take(n)]}, group="__positive")
    if sum(found.counts.values()) <= max_rows:
        return df
    last = found.key(take(found.counts), False)
    sampled = F.lit(False) if last is None else found.until(last)
    return found.df.filter(F.col("__positive") | sampled).drop("__h", "__positive", *found.added)


def first_rows(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """The first `rows` rows in `order`."""
    found = cuts(df, order, lambda _: {None: [rows]})
    last = found.key(rows)
    return df if last is None else found.df.filter(found.until(last)).drop(*found.added)


def bank_names(banks: int) -> tuple[str, ...]:
    return tuple(
        _FIRST_BANKS[i] if i < len(_FIRST_BANKS) else f"BANK-{i}" for i in range(banks)
    )


def with_bank_names(df: DataFrame, shard: str = "shard") -> DataFrame:
    letters = F.element_at(
        F.array(*[F.lit(b) for b in _FIRST_BANKS]),
        F.least(F.col(shard), F.lit(len(_FIRST_BANKS) - 1)) + 1,
    )
    numbered = F.concat(F.lit("BANK-"), F.col(shard).cast("string"))
    return df.withColumn(
        "bank_id", F.when(F.col(shard) < len(_FIRST_BANKS), letters).otherwise(numbered)
    )


def bank_sizes(df: DataFrame, banks: Sequence[str] | None = None) -> dict[str, tuple[int, int]]:
    """Rows and positives per bank; an empty bank is an error, and so are rows without one."""
    found = df.groupBy("bank_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    rows = found.limit(MAX_GROUPS + 1).collect()  # one per bank
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} banks")
    sizes = {r["bank_id"]: (r["n"], int(r["p"] or 0)) for r in rows}
    if None in sizes:
        raise ValueError(f"{sizes[None][0]} rows have no bank")
    empty = [b for b in banks or () if b not in sizes]
    if empty or not sizes:
        raise ValueError(f"empty bank shards: {empty}; use fewer banks or more rows")
    return dict(sorted(sizes.items()))
