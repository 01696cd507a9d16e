"""Money in integer minor units."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import constants as K


def _as_decimal(amount: Column) -> Column:
    """The amount with 18 decimals; NULL for text that is no number or has over 18 whole digits."""
    parsed = F.trim(amount.cast("string")).try_cast("decimal(38,18)")
    return F.when(parsed.try_cast("decimal(20,2)").isNotNull(), parsed)


def amount_reject_reason(amount: Column) -> Column:
    """`amount_invalid` for non-numbers, `amount_precision` for fractions of a minor unit."""
    value = _as_decimal(amount)
    # Digits past the 18th would be rounded away by the cast, so they are looked for in the text.
    hidden_digit = amount.cast("string").rlike(r"\.\d{18}\d*[1-9]")
    # Both sides keep 18 decimals: a comparison of unlike scales would round the finer one.
    too_fine = (value != value.cast("decimal(20,2)").cast("decimal(38,18)")) | hidden_digit
    return F.when(value.isNull(), F.lit("amount_invalid")).when(too_fine, F.lit("amount_precision"))


def to_minor_units(amount: Column) -> Column:
    """Major-unit amount (text or number) as BIGINT minor units; NULL when refused."""
    minor = (_as_decimal(amount).cast("decimal(20,2)") * K.MINOR_UNITS_PER_MAJOR).try_cast("bigint")
    return F.when(amount_reject_reason(amount).isNull(), minor)


def to_major_units(amount_minor: Column) -> Column:
    return (amount_minor.cast("decimal(20,0)") / K.MINOR_UNITS_PER_MAJOR).cast("decimal(20,2)")
