"""Signals, transfers and labelled rows derived from the provided tables.

Everything is a plain projection, filter or key join of a whole table, so the derived data grows
with it. The keys are public and for test use only.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import timecols
from riskweave.functions.accounts import Pseudonymiser, key_pads
from riskweave.functions.policy import PolicyConfig, PolicyVersions
from riskweave.operators import trust

TEST_KEY = bytes(range(1, 33))
BANKS = ("BANK-A", "BANK-B", "BANK-C", "BANK-D", "BANK-E")
OUTAGES = (
    ("2024-01-10 00:00:00", "2024-01-10 06:00:00"),
    ("2024-01-20 12:00:00", "2024-01-20 18:00:00"),
)
POLICY_CHANGE = "2024-01-15 00:00:00"
# (bank, action, key, when): BANK-E is revoked and comes back with a new key; BANK-B registers its
# key twice; someone tries to rebind BANK-C.
KEY_EVENTS = (
    *((b, "register", f"{b}/1", "2024-01-01 00:00:00") for b in BANKS),
    ("BANK-B", "register", "BANK-B/1", "2024-01-05 00:00:00"),
    ("BANK-C", "register", "BANK-C/stolen", "2024-01-06 00:00:00"),
    ("BANK-E", "revoke", None, "2024-01-15 00:00:00"),
    ("BANK-E", "register", "BANK-E/2", "2024-01-18 00:00:00"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonymiser(spark: SparkSession) -> Pseudonymiser:
    return Pseudonymiser.from_key(spark, TEST_KEY)


def _bank(number: Column) -> Column:
    return F.concat(F.lit("BANK-"), F.char(F.lit(65) + number % 5))


def account(number: Column) -> Column:
    return F.concat(F.lit("ACC-"), F.lpad(number.cast("string"), 6, "0"))


def events_as_signals(events: DataFrame) -> DataFrame:
    """Signals of an `events` frame, batch or streaming, before pseudonymisation."""
    n, ts = F.col("event_id"), F.col("ts")
    shift = (
        F.when(n % 97 == 0, 10)
        .when(n % 10 == 0, 3)
        .when(n % 10 == 1, -96 * 60)
        .otherwise(0)
    )
    code = (
        F.when(F.col("event_type") == "signup", "new_beneficiary")
        .when(F.col("event_type") == "click", "high_velocity")
        .when(F.col("event_type") == "view", "suspicious_pattern")
        .otherwise("mule_account")
    )
    return events.filter(F.col("event_type") != "purchase").select(
        n.alias("seq"),
        ts.alias("arrival_ts"),
        account(F.col("user_id")).alias("account"),
        _bank(n).alias("source_bank_id"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("risk_score"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("confidence"),
        F.array(code).alias("reason_codes"),
        F.concat(F.lit("m"), (n % 3).cast("string")).alias("model_version"),
        (1 + (n * 13) % 168).cast("int").alias("ttl_hours"),
        (ts + F.make_dt_interval(mins=shift)).alias("timestamp"),
    )


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = events_as_signals(table(spark, sf_dir, "events"))
    named = raw.withColumn("risk_id", pseudonymiser(spark).risk_id(F.col("account")))
    return named.drop("account")


def messy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every kind of broken field spread over its rows."""
    n = F.col("seq")
    codes = (
        F.when(n % 19 == 3, F.array(F.lit("Bad Code")))
        .when(n % 19 == 5, F.concat("reason_codes", "reason_codes"))
        .when(n % 19 == 7, F.array().cast("array<string>"))
        .when(n % 19 == 9, F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("code_"), i.cast("string"))))
        .otherwise(F.col("reason_codes"))
    )
    return signal_log(spark, sf_dir).withColumns(
        {
            "risk_id": F.when(n % 23 == 2, F.upper("risk_id")).when(n % 23 == 4, F.substring("risk_id", 1, 63)).otherwise(F.col("risk_id")),
            "risk_score": F.when(n % 29 == 6, 101).when(n % 29 == 8, -1).otherwise(F.col("risk_score")),
            "confidence": F.when(n % 31 == 1, F.lit(float("nan"))).when(n % 31 == 3, 1.01).otherwise(F.col("confidence")),
            "reason_codes": codes,
            "model_version": F.when(n % 37 == 5, "-bad version").otherwise(F.col("model_version")),
            "source_bank_id": F.when(n % 41 == 7, F.lower("source_bank_id")).otherwise(F.col("source_bank_id")),
            "ttl_hours": F.when(n % 43 == 9, 0).when(n % 43 == 11, 169).otherwise(F.col("ttl_hours")),
        }
    )


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as people type them: spaces of all kinds, lower case, look-alikes, junk."""
    n = F.col("event_id")
    base = account(F.col("user_id"))
    typed = (
        F.when(n % 12 == 1, F.concat(F.lit("  "), F.lower(base), F.lit("\n")))
        .when(n % 12 == 2, F.concat(F.lit("ACC\u00a0"), F.col("user_id").cast("string")))
        .when(n % 12 == 3, F.concat(F.lit("A\u2003CC\u3000-\x1f"), F.col("user_id").cast("string")))
        .when(n % 12 == 4, F.concat(F.lit("ACC_"), F.col("user_id").cast("string")))
        .when(n % 12 == 5, F.concat(F.lit("acc-\u0131"), F.col("user_id").cast("string")))
        .when(n % 12 == 6, F.concat(F.lit("STRA\u00dfE-"), F.col("user_id").cast("string")))
        .when(n % 12 == 7, F.lit("AC "))
        .when(n % 12 == 8, F.repeat(base, 4))
        .when(n % 12 == 9, F.concat(base, F.lit("\u200b")))
        .when(n % 12 == 10, F.concat(base, F.lit(";")))
        .otherwise(base)
    )
    return table(spark, sf_dir, "events").select(n.alias("seq"), typed.alias("account"))


def key_events(spark: SparkSession) -> DataFrame:
    rows = [(i, *e) for i, e in enumerate(KEY_EVENTS)]
    frame = spark.createDataFrame(
        rows, "seq int, bank_id string, action string, key_id string, event_ts string"
    )
    return frame.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


def tag_key(key_id: str) -> bytes:
    return hashlib.sha256(f"tag key {key_id}".encode()).digest()


def key_ring(spark: SparkSession) -> DataFrame:
    ids = sorted({e[2] for e in KEY_EVENTS if e[2]})
    rows = [(i, *key_pads(tag_key(i))) for i in ids]
    return spark.createDataFrame(rows, "key_id string, inner_pad binary, outer_pad binary")


def publishers(spark: SparkSession) -> DataFrame:
    """Validity intervals of the member banks with the pads of their tag keys."""
    return trust.trust_intervals(key_events(spark)).join(key_ring(spark), "key_id")


def tagged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as received: every row tagged with the sender's first key, then some rows altered,
    signed by another bank, or with a zero tag."""
    n = F.col("seq")
    first_key = F.concat(F.col("source_bank_id"), F.lit("/1"))
    signer = F.when(n % 13 == 5, F.lit("BANK-A/1")).otherwise(first_key)
    keys = key_ring(spark).withColumnRenamed("key_id", "signer")
    signed = (
        signal_log(spark, sf_dir)
        .withColumn("signer", signer)
        .join(F.broadcast(keys), "signer")
        .withColumn("tag", trust.payload_tag(F.col("inner_pad"), F.col("outer_pad")))
        .drop("signer", "inner_pad", "outer_pad")
    )
    return signed.withColumns(
        {
            "tag": F.when(n % 17 == 3, F.repeat(F.lit("0"), 64)).otherwise(F.col("tag")),
            "risk_score": F.when(n % 11 == 2, 0).otherwise(F.col("risk_score")),
            "ttl_hours": F.when(n % 11 == 4, 168).otherwise(F.col("ttl_hours")),
            "confidence": F.when(n % 11 == 6, F.lit(0.01)).otherwise(F.col("confidence")),
        }
    )


#: Added to the number of a request by its retry.
RETRY = 1_000_000_000_000


def transfer_requests(spark: SparkSession, sf_dir: str, retries: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    users = events.agg(F.max("user_id") + 1).scalar()
    requests = events_as_transfers(events, users)
    if not retries:
        return requests
    again = requests.filter(F.col("seq") % 7 == 0).withColumns(
        {
            "seq": F.col("seq") + RETRY,
            "request_ts": F.col("request_ts") + F.make_dt_interval(F.lit(0), F.lit(1)),
        }
    )
    return requests.unionByName(again)


def events_as_transfers(events: DataFrame, users: Column) -> DataFrame:
    """Transfers of an `events` frame, batch or streaming; `users` is the number of accounts."""
    n = F.col("event_id")
    receiver = account((F.col("user_id") * 7 + 3) % users)
    typed = F.when(n % 4 == 0, F.concat(F.lower(receiver), F.lit(" "))).otherwise(receiver)
    return events.filter(F.col("event_type") == "purchase").select(
        n.alias("seq"),
        F.col("ts").alias("request_ts"),
        F.concat(F.lit("TXN-"), F.lpad(n.cast("string"), 8, "0")).alias("transfer_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_ref"),
        _bank(n).alias("bank_id"),
        typed.alias("receiver_account"),
        (F.round(F.col("value") * 100).cast("bigint") * 1000).alias("amount_minor"),
        F.lit("INR").alias("currency"),
    )


def messy_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    return transfer_requests(spark, sf_dir).withColumns(
        {
            "user_ref": F.when(n % 9 == 1, F.concat("user_ref", F.lit("\u2028x")))
            .when(n % 9 == 2, F.lit(" \t "))
            .when(n % 9 == 3, F.concat(F.lit(" "), "user_ref", F.lit("\u00a0")))
            .otherwise(F.col("user_ref")),
            "bank_id": F.when(n % 11 == 4, F.repeat("bank_id", 6)).otherwise(F.col("bank_id")),
            "transfer_id": F.when(n % 13 == 5, F.substring("transfer_id", 1, 7)).otherwise(F.col("transfer_id")),
            "receiver_account": F.when(n % 17 == 6, F.lit("")).otherwise(F.col("receiver_account")),
            "amount_minor": F.when(n % 19 == 7, -F.col("amount_minor"))
            .when(n % 19 == 8, F.lit(10**16))
            .otherwise(F.col("amount_minor")),
            "currency": F.when(n % 23 == 9, F.lit("inr")).otherwise(F.col("currency")),
        }
    )


def outages(spark: SparkSession) -> DataFrame:
    frame = spark.createDataFrame(list(OUTAGES), "start_ts string, end_ts string")
    return frame.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in frame.columns])


def policy_table(spark: SparkSession) -> DataFrame:
    """Two policy versions: the defaults, then a stricter rule."""
    rows = [("2024-01-01 00:00:00", 85, 1), (POLICY_CHANGE, 70, 2)]
    frame = spark.createDataFrame(rows, "valid_from string, block_at int, min_banks_to_block int")
    return frame.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))


def signup_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy version at every instant of a signup, the last signup of the instant deciding."""
    last = F.max("event_id")
    starts = table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy("ts").agg(last.alias("n"))
    return starts.select(
        F.col("ts").alias("valid_from"),
        (F.lit(50) + F.col("n") % 50).cast("int").alias("block_at"),
        (1 + F.col("n") % 3).cast("int").alias("min_banks_to_block"),
    )


def policies(spark: SparkSession) -> PolicyVersions:
    return PolicyVersions.from_table(policy_table(spark))


def default_policies() -> PolicyVersions:
    return PolicyVersions.single(PolicyConfig())


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the fraud model: four features, a label whose direction differs per bank."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # Spark picks the join by size: the nations are broadcast, the suppliers where they are small.
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    identity = F.concat_ws(
        "|",
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    )
    features = F.array(
        F.col("l_quantity") / 50,
        F.col("l_extendedprice") / 100000,
        F.col("l_discount") / 0.1,
        F.col("l_tax") / 0.08,
    )
    direction = F.get(F.col("features"), F.col("n_regionkey") % 4)
    score = F.lit(0.25) * (
        F.col("features")[0] + F.col("features")[1] + F.col("features")[2] + F.col("features")[3]
    )
    return (
        lines.withColumn("features", features)
        .select(
            F.md5(identity).alias("id"),
            F.concat(F.lit("BANK-"), F.char(F.lit(65) + F.col("n_regionkey"))).alias("bank_id"),
            F.col("l_shipdate").alias("event_time"),
            timecols.micros(F.col("l_shipdate")).alias("event_micros"),
            "features",
            F.when(direction > 0.85, 1).otherwise(0).alias("label"),
            F.round(score, 3).alias("score"),
            F.col("l_suppkey").alias("supplier"),
        )
    )
