"""Labelled fraud tables from CSV, as rows of `row_id, label, event_time, features`."""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators import shards
from riskweave.sources.shared import stored

# Fixed value: the largest finite single-precision number, which infinities are clamped to.
MAX_FLOAT32 = 3.4028234663852886e38


@dataclass(frozen=True)
class LabelledRows:
    """`frame` has `row_id` (file order), `label`, `features` and, where `has_time`, `event_time`.
    `quarantined` has the lines of a file that do not fit its columns or carry no label."""

    name: str
    frame: DataFrame
    feature_names: tuple[str, ...]
    has_time: bool
    quarantined: DataFrame | None = None


def finite(value: Column) -> Column:
    """NaN and NULL become 0, infinities the largest single-precision number."""
    number = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(number, F.lit(MAX_FLOAT32)), F.lit(-MAX_FLOAT32))


def _shape(
    name: str, df: DataFrame, label: str, time: str | None, features: list[tuple[str, Column]]
) -> LabelledRows:
    # Row ids follow file order; a plain scan gives the same ids every time it is read.
    row_id = F.col("row_id") if "row_id" in df.columns else F.monotonically_increasing_id()
    columns = [row_id.alias("row_id"), F.col(label).cast("int").alias("label")]
    if time is not None:
        columns.append(F.col(time).cast("double").alias("event_time"))
    columns.append(F.array(*[c for _, c in features]).alias("features"))
    return LabelledRows(name, df.select(*columns), tuple(n for n, _ in features), time is not None)


def card_rows(df: DataFrame) -> LabelledRows:
    """Card payments: the `V*` components and the logarithm of the amount."""
    components = [c for c in df.columns if c.startswith("V")]
    features = [(c, F.col(c).cast("double")) for c in components]
    features.append(("log_amount", F.log1p(F.col("Amount").cast("double"))))
    return _shape("card", df, "Class", "Time", features)


def _numeric_rows(
    name: str, df: DataFrame, label: str, time: str, without: tuple[str, ...]
) -> LabelledRows:
    """Every numeric column but the label; the time column stays a feature as well."""
    skip = {label, "row_id", *without}
    numeric = [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    features = [(c, finite(F.col(c))) for c in numeric]
    return _shape(name, df, label, time if time in df.columns else None, features)


def mobile_money_rows(df: DataFrame, drop: tuple[str, ...] = ()) -> LabelledRows:
    label = "isFraud" if "isFraud" in df.columns else "Class"
    return _numeric_rows("mobile-money", df, label, "step", ("isFlaggedFraud", *drop))


def card_not_present_rows(df: DataFrame, drop: tuple[str, ...] = ()) -> LabelledRows:
    return _numeric_rows("card-not-present", df, "isFraud", "TransactionDT", drop)


# The dataset names users already pass.
_READERS: dict[str, Callable[[DataFrame], LabelledRows]] = {
    "ulb": card_rows,
    "creditcard": card_rows,
    "ieee-ulb": card_rows,
    "paysim": mobile_money_rows,
    "ieee-cis": card_not_present_rows,
    "ieee": card_not_present_rows,
    "ieee_cis": card_not_present_rows,
}


_CORRUPT = "_corrupt_record"


def _scan(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """A permissive scan: a line that does not fit keeps its text in a column of its own. All columns are
    parsed, whichever are used, so that a line is found corrupt or not for every use alike."""
    csv = spark.read.option("header", True)
    if schema is None:
        schema = csv.option("inferSchema", True).csv(path).schema
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    csv = csv.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    return csv.option("columnPruning", False).csv(path)


def load_dataset(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType | str | None = None,
    max_rows: int | None = None,
    seed: int = 42,
) -> LabelledRows:
    """Read a CSV by dataset name. Give a `schema` for large files: inferring one reads them twice.

    The file is parsed once and kept as Parquet in the shared folder, with the numbers of its rows, so they are
    the same for every later use. `max_rows` keeps all positives of card payments and a sample of the others;
    of other datasets it keeps the first rows.
    """
    reader = _READERS.get(name.lower().strip())
    if reader is None:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(_READERS))}")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    numbered = _scan(spark, path, schema).withColumn("row_id", F.monotonically_increasing_id())
    parsed = stored(numbered, "csv")
    sound = parsed.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    rows = reader(sound)
    unlabelled = rows.frame.filter(F.col("label").isNull()).select("row_id")
    bad = parsed.join(unlabelled.withColumn("__unlabelled", F.lit(True)), "row_id", "left")
    bad = bad.filter(F.col(_CORRUPT).isNotNull() | F.col("__unlabelled")).drop("__unlabelled")
    frame = rows.frame.filter(F.col("label").isNotNull())
    if max_rows is not None:
        if rows.name == "card":
            frame = shards.cap_keeping_positives(frame, max_rows, seed, row_id="row_id")
        else:
            frame = shards.first_rows(frame, max_rows, ["row_id"])
    return replace(rows, frame=frame, quarantined=bad)
