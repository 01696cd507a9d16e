"""Full-batch gradient descent of the fraud model as an aggregation.

Every bank's network is one row of a small table (`bank_id, n, pos_weight, params`), and a step is one pass
over all rows: the gradient is one sum per parameter, combined on the map side, so a bank's rows need not
meet. Nothing is sampled, and the order of the rows does not matter but for the last digits. The table of
networks is stored after each step, which cuts the lineage.

The rows are packed once into blocks of bytes, each of one bank, where they are; steps pass over the blocks, and
forward and backward are arithmetic on arrays of a block, in Python. `gradients` is the same on rows and columns,
without Python; there a network of 97 parameters is a method of 13 kB, the JVM compiles none over 8 kB, and
interpreting it takes about 57 microseconds a row.

`params` is flat: `w1` row by row, then `b1`, `w2` and `b2`. With one aggregate per parameter this is for the
small networks of this library; `training` fits larger ones by mini-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.scoring import LAYERS, MAX_LOGIT, Network
from riskweave.operators.skew import HotKeys, is_small, join_to_unique
from riskweave.sources.shared import checkpointed

#: Aggregates over the sums of the blocks; beyond it the JVM would not compile them.
MAX_PARAMETERS = 2_000
#: Bytes of a block at most, whose arrays should fit a core's cache, and of the rows that a task holds to pack them.
BLOCK_BYTES = 1 << 17
HELD_BYTES = 1 << 24
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Shape:
    features: int
    hidden: int

    @property
    def sizes(self) -> dict[str, int]:
        return dict(zip(LAYERS, (self.features * self.hidden, self.hidden, self.hidden, 1), strict=True))

    @property
    def starts(self) -> dict[str, int]:
        ends = np.cumsum([0, *self.sizes.values()])
        return {layer: int(start) for layer, start in zip(LAYERS, ends, strict=False)}

    @property
    def parameters(self) -> int:
        return sum(self.sizes.values())


def shape_of(net: Network) -> Shape:
    return Shape(*net.w1.shape)


def flat(net: Network) -> list[float]:
    return [value for _, _, value in net.entries()]


def network_of(params: list[float], shape: Shape) -> Network:
    entries = {}
    for layer, start in shape.starts.items():
        for i in range(shape.sizes[layer]):
            entries[layer, i] = params[start + i]
    return Network.from_entries(entries)


def bank_table(rows: DataFrame, net: Network) -> DataFrame:
    """Every bank of `rows` (`bank_id, label, features`) with its number of rows, the weight of its
    positive rows and `net`. Rows without a bank belong to none and are not trained on."""
    positives = F.sum("label")
    return (
        rows.filter(F.col("bank_id").isNotNull())
        .groupBy("bank_id")
        .agg(F.count(F.lit(1)).alias("n"), positives.alias("p"))
        .select(
            "bank_id",
            "n",
            (F.greatest(F.col("n") - F.col("p"), F.lit(1)) / F.greatest("p", F.lit(1))).alias("pos_weight"),
            _constant(flat(net)).alias("params"),
        )
    )


def _constant(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def packed(rows: DataFrame, shape: Shape) -> DataFrame:
    """All rows (`bank_id, label, features`) that have a bank, as blocks (`bank_id, rows, block`) of one bank each.

    A feature that is NULL, NaN or missing counts as 0, as in scoring; a NULL label counts as 0.
    """
    if shape.parameters > MAX_PARAMETERS:
        raise ValueError(f"{shape.parameters} parameters; fit networks over {MAX_PARAMETERS} by mini-batches")
    numbers = F.array(
        F.coalesce(F.col("label").cast("int"), F.lit(0)).cast("double"),
        *(F.coalesce(F.nanvl(F.get("features", F.lit(i)), F.lit(0.0)), F.lit(0.0)) for i in range(shape.features)),
    )
    given = rows.filter(F.col("bank_id").isNotNull()).select("bank_id", numbers.alias("numbers"))
    schema = given.select("bank_id").schema.add("rows", "long").add("block", "binary")
    return given.mapInArrow(_packer(1 + shape.features), schema)


def _packer(width: int) -> Callable[[Batches], Batches]:
    """Rows of `width` numbers to blocks, which have them number by number. Rows are held to make blocks large."""
    most = max(1, BLOCK_BYTES // (8 * width))

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        coded = pa.chunked_array([b.column(0) for b in held]).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        numbers = np.concatenate([b.column(1).flatten().to_numpy().reshape(-1, width) for b in held])
        bank, count, block = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            for cut in range(0, len(part), most):
                some = part[cut : cut + most]
                bank.append(codes[some[0]])
                count.append(len(some))
                block.append(numbers[some].T.astype("<f8").tobytes())
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(bank)), pa.array(count, pa.int64()), pa.array(block, pa.binary())],
            ["bank_id", "rows", "block"],
        )

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += 8 * width * batch.num_rows
            if size >= HELD_BYTES:
                yield blocks(held)
                held, size = [], 0
        if held:
            yield blocks(held)

    return run


def _block_sums(params: np.ndarray, pos_weight: float, block: np.ndarray, shape: Shape) -> np.ndarray:
    """The gradient summed over the rows of a block. NaN is greater than any number, as in Spark."""
    w1, b1, w2, b2 = np.split(params, [*shape.starts.values()][1:])
    y, x = block[0], block[1:]
    # Products are added in the order of the features: where they cancel out, rounding decides if a unit is active.
    pre = reduce(np.add, (np.outer(x[i], w) for i, w in enumerate(w1.reshape(shape.features, shape.hidden)))) + b1
    active = ~(pre <= 0)
    units = np.where(active, pre, 0.0)
    z = np.maximum(np.fmin(units @ w2 + b2, MAX_LOGIT), -MAX_LOGIT)
    slope = np.where(y == 1, pos_weight, 1.0) * (1.0 / (1.0 + np.exp(-z)) - y)
    back = np.where(active, np.outer(slope, w2), 0.0)
    return np.concatenate([(x @ back).ravel(), back.sum(axis=0), slope @ units, [slope.sum()]])


def _summing(shape: Shape) -> Callable[[Batches], Batches]:
    """Blocks with the network of their bank to the sum of each."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sums = np.empty((batch.num_rows, shape.parameters))
            params = batch["params"].flatten().to_numpy().reshape(sums.shape)
            weights = batch["pos_weight"].to_numpy()
            with np.errstate(all="ignore"):
                for i, block in enumerate(batch["block"]):
                    numbers = np.frombuffer(block.as_buffer(), "<f8").reshape(1 + shape.features, -1)
                    sums[i] = _block_sums(params[i], weights[i], numbers, shape)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * shape.parameters
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch["bank_id"], batch["rows"], found], ["bank_id", "rows", "sums"])

    return run


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def gradients(rows: DataFrame, banks: DataFrame, shape: Shape, hot: HotKeys | None = None) -> DataFrame:
    """(bank_id, gradient): the gradient of each bank's mean class-weighted cross-entropy over its rows.

    A feature that is NULL, NaN or missing counts as 0, as in scoring; a NULL label counts as 0. The table
    of banks is broadcast if it was counted to be small; else its rows are joined, with heavy banks (`hot`) split.
    """
    if shape.parameters > MAX_PARAMETERS:
        raise ValueError(f"{shape.parameters} parameters; fit networks over {MAX_PARAMETERS} by mini-batches")
    start = shape.starts

    def param(layer: str, i: int) -> Column:
        return F.col("params")[start[layer] + i]

    few = is_small(banks)
    known = banks.select("bank_id", "pos_weight", "params")
    inputs = [
        F.coalesce(F.nanvl(F.get(F.col("features"), F.lit(i)), F.lit(0.0)), F.lit(0.0)).alias(f"__x{i}")
        for i in range(shape.features)
    ]
    given = rows.select("bank_id", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("__y"), *inputs)
    if few:
        joined = given.join(F.broadcast(known), "bank_id")
    else:
        joined = join_to_unique(given, known, ["bank_id"], "inner", hot, ["__x0"])
    units, inner = range(shape.hidden), range(shape.features)
    x = [F.col(f"__x{i}") for i in inner]
    pre = {
        f"__a{j}": _total([x[i] * param("w1", i * shape.hidden + j) for i in inner]) + param("b1", j) for j in units
    }
    a = [F.col(f"__a{j}") for j in units]
    z = _total([F.greatest(a[j], F.lit(0.0)) * param("w2", j) for j in units]) + param("b2", 0)
    p = 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(MAX_LOGIT)), F.lit(-MAX_LOGIT))))
    slope = F.when(F.col("__y") == 1, F.col("pos_weight")).otherwise(1.0) * (p - F.col("__y"))
    back = {f"__d{j}": F.when(a[j] > 0, F.col("__slope") * param("w2", j)).otherwise(0.0) for j in units}
    rated = joined.withColumns(pre).withColumn("__slope", slope).withColumns(back)
    d = [F.col(f"__d{j}") for j in units]
    terms = [
        *(x[i] * d[j] for i in inner for j in units),
        *d,
        *(F.greatest(a[j], F.lit(0.0)) * F.col("__slope") for j in units),
        F.col("__slope"),
    ]
    sums = rated.groupBy("bank_id").agg(
        F.count(F.lit(1)).alias("__n"), *(F.sum(t).alias(f"__g{k}") for k, t in enumerate(terms))
    )
    mean = F.array(*(F.col(f"__g{k}") / F.col("__n") for k in range(len(terms))))
    return sums.select("bank_id", mean.alias("gradient"))


def block_gradients(blocks: DataFrame, banks: DataFrame, shape: Shape, hot: HotKeys | None = None) -> DataFrame:
    """`gradients` of `packed` rows.

    The table of banks is broadcast if it was counted to be small; else its rows are joined, with the blocks of heavy
    banks (`hot`) split.
    """
    known = banks.select("bank_id", "pos_weight", "params")
    if is_small(banks):
        joined = blocks.join(F.broadcast(known), "bank_id")
    else:
        joined = join_to_unique(blocks, known, ["bank_id"], "inner", hot, ["block"])
    schema = joined.select("bank_id").schema.add("rows", "long").add("sums", T.ArrayType(T.DoubleType()))
    by_block = joined.select("bank_id", "rows", "pos_weight", "params", "block").mapInArrow(_summing(shape), schema)
    total = by_block.groupBy("bank_id").agg(
        F.sum("rows").alias("__n"), *(F.sum(F.col("sums")[k]).alias(f"__g{k}") for k in range(shape.parameters))
    )
    mean = F.array(*(F.col(f"__g{k}") / F.col("__n") for k in range(shape.parameters)))
    return total.select("bank_id", mean.alias("gradient"))


def step(blocks: DataFrame, banks: DataFrame, shape: Shape, rate: float, hot: HotKeys | None = None) -> DataFrame:
    """The table of banks after one step down the gradient of the `packed` rows."""
    found = block_gradients(blocks, banks, shape, hot)
    moved = F.zip_with("params", "gradient", lambda w, g: w - F.lit(rate) * g)
    return banks.join(found, "bank_id").select("bank_id", "n", "pos_weight", moved.alias("params"))


def descend(
    blocks: DataFrame, banks: DataFrame, shape: Shape, rate: float, steps: int, hot: HotKeys | None = None
) -> DataFrame:
    """The table of banks after `steps` steps, every bank alone with its own network; stored after each."""
    for _ in range(steps):
        banks = checkpointed(step(blocks, banks, shape, rate, hot))
    return banks


def parameters(banks: DataFrame, shape: Shape) -> DataFrame:
    """The networks as `bank_id, n, layer, pos, value`, the form in which updates are averaged and saved."""
    layer, first = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, start in reversed(shape.starts.items()):
        inside = F.col("k") < start + shape.sizes[name]
        layer, first = F.when(inside, name).otherwise(layer), F.when(inside, start).otherwise(first)
    long = banks.select("bank_id", "n", F.posexplode("params").alias("k", "value"))
    return long.select("bank_id", "n", layer.alias("layer"), (F.col("k") - first).cast("int").alias("pos"), "value")
