"""Row rules of signals and transfers.

A rule is a name and a condition. `violations` names the broken ones, for quarantine; `all_hold` is
a plain conjunction, for filters: it compiles and stops at the first broken rule.
"""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions import timecols


Rules = list[tuple[str, Column]]


def violations(rules: Rules) -> Column:
    """Names of the rules whose condition is not TRUE (NULL counts as violated)."""
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return F.array_compact(F.array(*names))


def all_hold(rules: Rules) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, [ok for _, ok in rules]), F.lit(False))


def signal_rules(unknown_fields: Column | None = None) -> Rules:
    """Rules of a published signal, relative to its `arrival_ts`."""
    codes, score, stamp = F.col("reason_codes"), F.col("risk_score"), F.col("timestamp")
    confidence = F.col("confidence")
    rules = [
        ("risk_id_format", F.col("risk_id").rlike(K.RISK_ID_PATTERN)),
        ("risk_score_range", score.between(0, 100)),
        # NaN sorts above every number in Spark, so the upper bound refuses it too.
        ("confidence_range", confidence.between(0.0, 1.0)),
        ("reason_codes_count", F.size(codes).between(1, K.MAX_REASON_CODES)),
        ("reason_code_format", F.forall(codes, lambda c: c.rlike(K.REASON_CODE_PATTERN))),
        ("reason_codes_duplicate", F.size(F.array_distinct(codes)) == F.size(codes)),
        ("model_version_format", F.col("model_version").rlike(K.MODEL_VERSION_PATTERN)),
        ("bank_id_format", F.col("source_bank_id").rlike(K.BANK_ID_PATTERN)),
        ("ttl_range", F.col("ttl_hours").between(K.MIN_TTL_HOURS, K.MAX_TTL_HOURS)),
        ("timestamp_missing", stamp.isNotNull()),
        (
            "timestamp_future",
            stamp.isNull() | (stamp <= timecols.latest_tolerated(F.col("arrival_ts"))),
        ),
    ]
    if unknown_fields is not None:
        rules.append(("unknown_field", F.size(unknown_fields) == 0))
    return rules


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(K.WHITESPACE))


# Longest and shortest raw text of each free-text field of a transfer.
_TEXT_LIMITS = {
    "transfer_id": (8, 64),
    "user_ref": (1, 64),
    "bank_id": (1, 32),
    "receiver_account": (1, 64),
}


def transfer_rules(unknown_fields: Column | None = None) -> Rules:
    """Rules of a transfer request. Lengths are of the raw text; the rest is of the stripped one."""
    rules = []
    for name, (low, high) in _TEXT_LIMITS.items():
        raw, bare = F.col(name), strip(F.col(name))
        rules += [
            (f"{name}_length", F.length(raw).between(low, high)),
            (f"{name}_blank", raw.isNull() | (F.length(bare) > 0)),
            (f"{name}_charset", raw.isNull() | bare.rlike(K.PRINTABLE_ASCII_PATTERN)),
        ]
    amount = F.col("amount_minor")
    rules.append(("amount_range", (amount > 0) & (amount <= K.MAX_AMOUNT_MINOR)))
    rules.append(("currency_format", F.col("currency").rlike(K.CURRENCY_PATTERN)))
    if unknown_fields is not None:
        rules.append(("unknown_field", F.size(unknown_fields) == 0))
    return rules


def unknown_json_fields(raw: Column, allowed: Iterable[str]) -> Column:
    """Top-level keys of a JSON object that the contract does not name."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(a) for a in allowed]))
