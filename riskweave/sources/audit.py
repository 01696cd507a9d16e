"""The audit table: append-only Parquet by day of decision."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = "decided_on"


def append_audit(audit: DataFrame, path: str) -> None:
    # The rebalance hint lets adaptive execution split a heavy day and merge thin ones, so files
    # have an even size.
    dated = audit.withColumn(_DAY, F.col("decided_at").cast("date")).hint("rebalance", F.col(_DAY))
    dated.write.mode("append").partitionBy(_DAY).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_DAY)
