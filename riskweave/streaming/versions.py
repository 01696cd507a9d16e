"""State kept between the steps of a stream: runs of changed rows, merged by levels, under one commit row.

A table is a set of runs. A step writes the rows it changed as a new run of level 0; `FANOUT` runs of a level
are merged into one of the next, so a table of n steps has about `FANOUT` times log n runs and every row
is rewritten once per level. Runs are divided into buckets by a hash of their key, and a step reads only the
buckets that its rows touch. Tables that only grow (histories) are written once per step and never read by steps.

The commit is a single row: the number of the step, the runs in use and the landing batches folded so far. Two
folders take turns, so a commit replaces the last but one and the last stays whole until the new one is
there. What a step that died has written is not named by any commit; the step's next run replaces it.
There is one writer. Files of runs no longer in use are left to the storage's own expiry rules.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of one level that are merged into one of the next.
FANOUT = 8
#: Level of what a compaction writes: it is merged by compactions only.
BASE = 15
#: Buckets of a new store.
BUCKETS = 16
#: A landing batch may carry a number this much (milliseconds) below one that was folded before it.
CLOCK_STEP_BACK = 86_400_000
_BUCKET = "__bucket"
_COMMIT = (
    "version bigint, buckets int, runs array<struct<table:string,id:bigint,level:int>>, "
    "folded_to bigint, folded_since array<bigint>"
)
Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    table: str
    id: int
    level: int


@dataclass(frozen=True)
class Commit:
    """State after a step. Landing batches up to `folded_to` and those in `folded_since` are folded;
    the list is bounded by `CLOCK_STEP_BACK`."""

    version: int = -1
    buckets: int = BUCKETS
    runs: tuple[Run, ...] = ()
    folded_to: int = -1
    folded_since: tuple[int, ...] = ()

    def next(self) -> Commit:
        return replace(self, version=self.version + 1)

    def of(self, table: str) -> list[Run]:
        return [r for r in self.runs if r.table == table]

    def unfolded(self, batch: Column) -> Column:
        """Whether a landing batch is still to be folded. As a filter on a partition column it keeps
        the files of folded batches from being read."""
        later = batch > F.lit(self.folded_to)
        return later & ~batch.isin(list(self.folded_since)) if self.folded_since else later

    def with_folded(self, batches: list[int]) -> Commit:
        known = {*self.folded_since, *batches}
        floor = max(self.folded_to, max(known, default=-1) - CLOCK_STEP_BACK)
        return replace(self, folded_to=floor, folded_since=tuple(sorted(b for b in known if b > floor)))


@dataclass(frozen=True)
class Change:
    """Rows for a merged table, dealt into buckets by `key`; `merge` folds the rows of several runs."""

    table: str
    rows: DataFrame
    key: str
    schema: T.StructType
    merge: Merge


@dataclass
class StepStore:
    """The tables of one store under `path`."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    _slots: tuple[str, str] = field(default=("even", "odd"), repr=False)

    # Commits ------------------------------------------------------------------------------------

    def last(self) -> Commit:
        found = []
        for slot in self._slots:
            try:
                found += self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commit/{slot}").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        if not found:
            return Commit(buckets=self.buckets)
        row = max(found, key=lambda r: r["version"])
        runs = tuple(Run(r["table"], r["id"], r["level"]) for r in row["runs"])
        return Commit(row["version"], row["buckets"], runs, row["folded_to"], tuple(row["folded_since"]))

    def commit(self, state: Commit) -> None:
        runs = [F.struct(*map(F.lit, (r.table, r.id, r.level))) for r in state.runs]
        row = {
            "version": F.lit(state.version),
            "buckets": F.lit(state.buckets),
            "runs": F.array(*runs),
            "folded_to": F.lit(state.folded_to),
            "folded_since": F.array(*map(F.lit, state.folded_since)),
        }
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(_COMMIT)}
        one = self.spark.range(0, 1, 1, 1).select(*(c.cast(kinds[name]).alias(name) for name, c in row.items()))
        one.write.mode("overwrite").parquet(f"{self.path}/commit/{self._slots[state.version % 2]}")

    # Histories ----------------------------------------------------------------------------------

    def write(self, table: str, version: int, df: DataFrame, day: str | None = None, **options: str) -> None:
        """A step's rows of a history, by day of the timestamp column `day`."""
        folder = f"{self.path}/{table}/version={version}"
        writer = df.withColumn(f"{day}_on", F.col(day).cast("date")).write if day else df.write
        writer = writer.partitionBy(f"{day}_on") if day else writer
        writer.mode("overwrite").options(**options).parquet(folder)

    def written(self, table: str, version: int, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/version={version}")

    def history(self, table: str, schema: T.StructType, day: str | None = None) -> DataFrame:
        """Committed rows. Steps are numbered without gaps and replace what a dead step has left, so all
        up to the last number are committed. With `day`, its partition column `<day>_on` is kept."""
        last = self.last().version
        days = [T.StructField(f"{day}_on", T.DateType())] if day else []
        full = T.StructType([*schema.fields, T.StructField("version", T.LongType()), *days])
        try:
            rows = self.spark.read.schema(full).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], full)
        return rows.filter(F.col("version") <= last).drop("version")

    # Merged tables ------------------------------------------------------------------------------

    def bucket(self, key: str, state: Commit) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(state.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str, state: Commit) -> list[int]:
        """The buckets that hold the keys of `rows`."""
        return sorted(r[0] for r in rows.select(self.bucket(key, state)).distinct().collect())

    def read(self, runs: list[Run], schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """Unmerged rows of some runs of one table; with `buckets`, other buckets' files are not read."""
        full = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        if not runs:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{r.table}/run={r.id}" for r in runs]
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/{runs[0].table}").parquet(*paths)
        if buckets is not None:
            rows = rows.filter(F.col(_BUCKET).isin(buckets))
        return rows.select(*schema.names)

    def add(self, state: Commit, changes: list[Change]) -> Commit:
        """Write the changes of `state`'s step as runs, and merge levels that are full; tables side by side."""
        return self._each(state, changes, self._add)

    def replace_all(self, state: Commit, changes: list[Change]) -> Commit:
        """Write the changes as the only runs of their tables."""
        return self._each(state, changes, lambda s, c: self._put(s, c, BASE, c.rows, tuple(s.of(c.table))))

    def _each(self, state: Commit, changes: list[Change], write: Callable[[Commit, Change], Commit]) -> Commit:
        tables = {c.table for c in changes}
        with ThreadPoolExecutor(len(changes)) as pool:
            after = list(pool.map(lambda c: write(state, c).of(c.table), changes))
        return replace(state, runs=(*(r for r in state.runs if r.table not in tables), *chain(*after)))

    def _add(self, state: Commit, change: Change) -> Commit:
        state = self._put(state, change, 0, change.rows, ())
        level = 0
        while len(full := [r for r in state.of(change.table) if r.level == level]) >= FANOUT:
            merged = change.merge(self.read(full, change.schema))
            state = self._put(state, change, level + 1, merged, tuple(full))
            level += 1
        return state

    def _put(self, state: Commit, change: Change, level: int, df: DataFrame, instead: tuple[Run, ...]) -> Commit:
        run = Run(change.table, state.version * (BASE + 1) + level, level)
        dealt = df.withColumn(_BUCKET, self.bucket(change.key, state)).repartition(_BUCKET)
        dealt.write.partitionBy(_BUCKET).mode("overwrite").parquet(f"{self.path}/{change.table}/run={run.id}")
        return replace(state, runs=(*(r for r in state.runs if r not in instead), run))
