"""Which publishers are trusted when, and whether a signal is what its publisher sent.

The tag is symmetric: it proves that a row was not changed and that another bank did not write it,
but whoever verifies could also forge. A public-key signature would be stronger; it needs a crypto
library per row, which this library leaves to the ingest edge.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.accounts import hmac_sha256
from riskweave.operators.skew import join_dimension

_PAYLOAD_DOMAIN = "risk-signal-v1\n"
TRUSTED, UNKNOWN_PUBLISHER, SIGNATURE_INVALID = "trusted", "unknown_publisher", "signature_invalid"


def registration_outcomes(events: DataFrame) -> DataFrame:
    """Outcome of each key event (`bank_id, action, key_id, event_ts, seq`).

    A bank is registered exactly when its previous event was a registration: registering again
    never rebinds the key, so a rotation has to go through a revocation.
    """
    order = Window.partitionBy("bank_id").orderBy("event_ts", "seq")
    opens = (F.col("action") == "register") & (
        F.coalesce(F.lag("action").over(order), F.lit("revoke")) == "revoke"
    )
    bound = F.last(F.when(F.col("__opens"), F.col("key_id")), ignorenulls=True).over(order)
    outcome = (
        F.when(F.col("action") == "revoke", F.lit("revoked"))
        .when(F.col("__opens"), F.lit("registered"))
        .when(F.col("key_id") == F.col("__bound"), F.lit("already_registered"))
        .otherwise(F.lit("refused"))
    )
    return (
        events.withColumn("__opens", opens)
        .withColumn("__bound", bound)
        .withColumn("outcome", outcome)
        .drop("__opens", "__bound")
    )


def trust_intervals(events: DataFrame) -> DataFrame:
    """Validity intervals `[valid_from, valid_to)` of each bank's key; open ones end in NULL."""
    steps = registration_outcomes(events).filter(F.col("outcome").isin("registered", "revoked"))
    order = Window.partitionBy("bank_id").orderBy("event_ts", "seq")
    ends = F.lead("event_ts").over(order)
    return (
        steps.withColumn("valid_to", ends)
        .filter(F.col("outcome") == "registered")
        .select("bank_id", "key_id", F.col("event_ts").alias("valid_from"), "valid_to")
    )


def with_publisher(log: DataFrame, publishers: DataFrame) -> DataFrame:
    """Add `trust` and, for a trusted row, the publisher columns in force at its arrival."""
    arrival = F.col("arrival_ts")
    in_force = [
        arrival >= F.col("valid_from"),
        F.col("valid_to").isNull() | (arrival < F.col("valid_to")),
    ]
    joined = join_dimension(
        log, publishers, in_force, ("source_bank_id", "bank_id"), "left", ["seq"]
    )
    trust = F.when(F.col("bank_id").isNotNull(), F.lit(TRUSTED)).otherwise(F.lit(UNKNOWN_PUBLISHER))
    return joined.withColumn("trust", trust).drop("bank_id", "valid_from", "valid_to")


def canonical_payload() -> Column:
    """Every signal field as compact JSON with sorted keys, under a domain prefix."""
    text = F.struct(
        F.col("confidence").cast("string").alias("confidence"),
        F.col("model_version").alias("model_version"),
        F.col("reason_codes").alias("reason_codes"),
        F.col("risk_id").alias("risk_id"),
        F.col("risk_score").cast("string").alias("risk_score"),
        F.col("source_bank_id").alias("source_bank_id"),
        F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("ttl_hours").cast("string").alias("ttl_hours"),
    )
    return F.concat(F.lit(_PAYLOAD_DOMAIN), F.to_json(text, {"ignoreNullFields": "false"}))


def payload_tag(inner_pad: Column, outer_pad: Column) -> Column:
    return hmac_sha256(canonical_payload(), inner_pad, outer_pad)


def verify_payloads(log: DataFrame, publishers: DataFrame) -> DataFrame:
    """Add `integrity`: trusted, unknown_publisher or signature_invalid.

    `log.tag` is the hex tag that came with the row; `publishers` carries the `inner_pad` and
    `outer_pad` of each bank's key per validity interval.
    """
    known = with_publisher(log, publishers)
    expected = payload_tag(F.col("inner_pad"), F.col("outer_pad"))
    genuine = F.coalesce(F.lower(F.col("tag")) == expected, F.lit(False))
    integrity = (
        F.when(F.col("trust") != TRUSTED, F.col("trust"))
        .when(genuine, F.lit(TRUSTED))
        .otherwise(F.lit(SIGNATURE_INVALID))
    )
    return known.withColumn("integrity", integrity).select(*log.columns, "integrity")
