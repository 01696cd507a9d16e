"""Account canonicalisation and keyed pseudonyms."""

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import constants as K

_HASH_BLOCK = 64


def squeeze(account: Column) -> Column:
    """The account with every whitespace code point removed."""
    return F.translate(account, K.WHITESPACE, "")


def account_reject_reason(account: Column) -> Column:
    """NULL for a usable account. Non-ASCII is refused before case folding: folding could merge."""
    compact = squeeze(account)
    return F.when(
        ~F.coalesce(compact.rlike(K.ACCOUNT_PATTERN), F.lit(False)),
        F.when(account.isNull(), F.lit("missing"))
        .when(compact.rlike(K.NON_ASCII_PATTERN), F.lit("non_ascii"))
        .otherwise(F.lit("malformed")),
    )


def normalize_account(account: Column) -> Column:
    """Canonical account, or NULL where `account_reject_reason` names a reason."""
    compact = squeeze(account)
    return F.when(compact.rlike(K.ACCOUNT_PATTERN), F.upper(compact))


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer HMAC-SHA256 pads of a key."""
    if len(key) < K.MIN_KEY_BYTES:
        raise ValueError(f"key must have at least {K.MIN_KEY_BYTES} bytes, got {len(key)}")
    block = hashlib.sha256(key).digest() if len(key) > _HASH_BLOCK else key
    block = block.ljust(_HASH_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(message: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """Lower-hex HMAC-SHA256 from built-in expressions (stays in generated code)."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


@dataclass(frozen=True)
class Pseudonymiser:
    """Holds a key as a one-row relation.

    The pads enter a plan as scalar subqueries, so neither `explain` nor the UI prints them; a
    literal would.
    """

    pads: DataFrame

    @classmethod
    def from_key(cls, spark: SparkSession, key: bytes) -> "Pseudonymiser":
        return cls(spark.createDataFrame([key_pads(key)], "inner_pad binary, outer_pad binary"))

    def risk_id(self, account: Column) -> Column:
        """Pseudonym of an account, NULL when the account is malformed."""
        return self.risk_id_of_normalized(normalize_account(account))

    def risk_id_of_normalized(self, account_norm: Column) -> Column:
        inner = self.pads.select("inner_pad").scalar()
        outer = self.pads.select("outer_pad").scalar()
        return hmac_sha256(account_norm, inner, outer)

    def with_risk_id(self, df: DataFrame, account: str = "account") -> DataFrame:
        """Add `account_norm`, `account_reject` and `risk_id`."""
        raw = F.col(account)
        return (
            df.withColumn("account_reject", account_reject_reason(raw))
            .withColumn("account_norm", normalize_account(raw))
            .withColumn("risk_id", self.risk_id_of_normalized(F.col("account_norm")))
        )
