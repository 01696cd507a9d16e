"""Stateless Structured Streaming queries that validate rows and land them in Parquet.

They are native from end to end, so the file sink makes them exactly-once. State is kept by the
batch steps of `publish` and `decide`, which can also be called from `foreachBatch`.

A landed table is partitioned by whether its rows were admitted and by landing batch: the time that the
engine logged for the micro-batch before running it, so a batch that is run again has the same number.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions.accounts import Pseudonymiser
from riskweave.operators import signals, transfers, trust

FATE, BATCH = "fate", "landing_batch"
ADMITTED, QUARANTINED = "admitted", "quarantined"


def _land(rows: DataFrame, admitted: Column, path: str, checkpoint: str) -> StreamingQuery:
    return (
        # In a stream the current time is that of the micro-batch, as written to its log.
        rows.withColumns(
            {
                FATE: F.when(admitted, ADMITTED).otherwise(QUARANTINED),
                BATCH: F.unix_millis(F.current_timestamp()),
            }
        )
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(FATE, BATCH)
        .trigger(availableNow=True)
        .start()
    )


def land_signals(
    stream: DataFrame, path: str, checkpoint: str, publishers: DataFrame | None = None
) -> StreamingQuery:
    """Land signals with their `violations`. A row that arrives late is kept: its publisher has to
    learn the outcome, so no watermark drops it.

    With `publishers` (validity intervals with the pads of their keys, `trust.trust_intervals`) every row's tag is
    checked against the key in force at its arrival, and `integrity` says what was found. Rows that break a
    rule or are not authentic land in quarantine.
    """
    checked = signals.with_violations(stream)
    sound = F.size("violations") == 0
    if publishers is not None:
        checked = trust.verify_payloads(checked, publishers)
        sound = sound & (F.col("integrity") == trust.TRUSTED)
    return _land(checked, sound, path, checkpoint)


def land_transfers(
    stream: DataFrame, pseudonymiser: Pseudonymiser, path: str, checkpoint: str
) -> StreamingQuery:
    """Land valid requests with `risk_id`; those with a malformed receiver (`account_reject`) land in
    quarantine."""
    valid = transfers.valid_transfers(stream)
    named = pseudonymiser.with_risk_id(valid, "receiver_account").drop("account_norm")
    return _land(named, F.col("account_reject").isNull(), path, checkpoint)


def _landed_schema(*fields: T.StructField) -> T.StructType:
    return T.StructType([*fields, T.StructField(FATE, T.StringType()), T.StructField(BATCH, T.LongType())])


#: Given to the readers, so that no file of an earlier batch is opened for its schema.
LANDED_SIGNALS = _landed_schema(
    *signals.SIGNAL_SCHEMA.fields, T.StructField("violations", T.ArrayType(T.StringType()))
)
LANDED_TRANSFERS = _landed_schema(
    T.StructField("seq", T.LongType()),
    T.StructField("request_ts", T.TimestampNTZType()),
    *(T.StructField(c, T.StringType()) for c in ("transfer_id", "user_ref", "bank_id", "receiver_account")),
    T.StructField("amount_minor", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("currency", "account_reject", "risk_id")),
)


def _admitted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).filter(F.col(FATE) == ADMITTED).drop(FATE)


def admitted_signals(spark: SparkSession, path: str) -> DataFrame:
    """Admitted rows of a landed table with their landing batch, for the steps of a store."""
    return _admitted(spark, path, LANDED_SIGNALS)


def admitted_transfers(spark: SparkSession, path: str) -> DataFrame:
    return _admitted(spark, path, LANDED_TRANSFERS)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(FATE) == QUARANTINED).drop(FATE)


def landed(df: DataFrame) -> DataFrame:
    """A landed table without its partition columns."""
    return df.drop(FATE, BATCH)
