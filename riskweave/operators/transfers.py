"""Transfer requests: validation, idempotency, audit records and what the customer sees.

A request row has the transfer fields plus `request_ts` and `seq` (unique per request).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import checks, money
from riskweave.functions import constants as K
from riskweave.functions import policy as rules
from riskweave.operators.barrier import computed_once
from riskweave.operators.lookup import lookup
from riskweave.operators.policies import PolicyTable
from riskweave.operators.skew import (
    ROWS_PER_TASK,
    HotKeys,
    find_hot_keys,
    join_to_unique,
    touching,
)

AUDIT_COLUMNS = [
    "transfer_id",
    "user_ref",
    "bank_id",
    "receiver_account",
    "amount_minor",
    "currency",
    "risk_id",
    "decision",
    "lookup_status",
    "risk_score",
    "reason_codes",
    "contributing_banks",
    "model_version",
    "policy",
    "decided_at",
]
CUSTOMER_COLUMNS = ["decision", "user_message", "audit_ref"]


def parse_transfer_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """Typed requests from JSON text (`seq`, `request_ts`, body), with the unknown field names.

    A missing `transfer_id` is derived from the request, so a recomputed task gives the same one.
    """
    shape = (
        "transfer_id string, user_ref string, bank_id string, receiver_account string, "
        "amount_minor string, currency string"
    )
    t = F.from_json(F.col(body), shape)
    own_id = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col(body)), 256)
    return raw.select(
        "seq",
        "request_ts",
        F.coalesce(t["transfer_id"], F.substring(own_id, 1, 36)).alias("transfer_id"),
        t["user_ref"].alias("user_ref"),
        t["bank_id"].alias("bank_id"),
        t["receiver_account"].alias("receiver_account"),
        t["amount_minor"].try_cast("bigint").alias("amount_minor"),
        F.coalesce(t["currency"], F.lit(K.DEFAULT_CURRENCY)).alias("currency"),
        checks.unknown_json_fields(F.col(body), K.TRANSFER_FIELDS).alias("unknown_fields"),
    )


def from_major_units(requests: DataFrame, amount: str = "amount") -> DataFrame:
    """Replace a major-unit amount by `amount_minor`, with `amount_reject` naming refused ones."""
    value = F.col(amount)
    return requests.withColumns(
        {"amount_reject": money.amount_reject_reason(value), "amount_minor": money.to_minor_units(value)}
    )


def _rules(requests: DataFrame) -> checks.Rules:
    unknown = F.col("unknown_fields") if "unknown_fields" in requests.columns else None
    return checks.transfer_rules(unknown)


def with_violations(requests: DataFrame) -> DataFrame:
    return requests.withColumn("violations", checks.violations(_rules(requests)))


def valid_transfers(requests: DataFrame) -> DataFrame:
    """Valid requests with their text fields stripped."""
    texts = ("transfer_id", "user_ref", "bank_id", "receiver_account")
    stripped = {c: checks.strip(F.col(c)) for c in texts}
    checked = requests.withColumns({**stripped, "__valid": checks.all_hold(_rules(requests))})
    kept = computed_once(checked, "transfers-checked").filter("__valid")
    return kept.drop("__valid", "unknown_fields")


def quarantined_transfers(requests: DataFrame) -> DataFrame:
    return with_violations(requests).filter(F.size("violations") > 0)


def first_requests(requests: DataFrame) -> DataFrame:
    """The first request of every `transfer_id`, which alone is decided."""
    payload = [c for c in requests.columns if c != "transfer_id"]
    first = F.min_by(F.struct(*payload), F.struct("request_ts", "seq"))
    return requests.groupBy("transfer_id").agg(first.alias("first")).select("transfer_id", "first.*")


def hot_transfer_ids(requests: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> HotKeys | None:
    return find_hot_keys(requests, ["transfer_id"], rows_per_task=rows_per_task)


def undecided(requests: DataFrame, audit: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Requests whose `transfer_id` has no audit record yet."""
    decided = touching(audit.select("transfer_id"), requests, ["transfer_id"]).distinct()
    return join_to_unique(requests, decided, ["transfer_id"], "left_anti", hot, ["seq"])


def replay_decisions(
    requests: DataFrame, audit: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Give every request, retries included, the one decision recorded for its `transfer_id`."""
    recorded = audit.select("transfer_id", "decision", "decided_at")
    return join_to_unique(
        requests.select("transfer_id", "seq", "request_ts"),
        recorded,
        ["transfer_id"],
        "inner",
        hot,
        ["seq"],
    )


def apply_policy(risk: DataFrame, policies: rules.PolicyVersions | PolicyTable, strict: bool = False) -> DataFrame:
    """Add the `policy` in force at `request_ts` and the `decision` under it."""
    if isinstance(policies, PolicyTable):
        with_policy = policies.apply(risk)
    else:
        with_policy = risk.withColumn("policy", policies.at(F.col("request_ts")))
    return with_policy.withColumn(
        "decision",
        rules.decision(
            F.col("lookup_status"),
            F.col("risk_score"),
            F.col("amount_minor"),
            F.col("confidence"),
            F.size("contributing_banks"),
            F.col("policy"),
            strict,
        ),
    )


def audit_records(decided: DataFrame, decided_at: Column | None = None) -> DataFrame:
    """One durable record per decision. A request is decided at its own time unless told."""
    moment = F.col("request_ts") if decided_at is None else decided_at
    no_codes = F.array().cast("array<string>")
    return decided.withColumns(
        {"decided_at": moment, "reason_codes": F.coalesce("reason_codes", no_codes)}
    ).select(*AUDIT_COLUMNS)


def customer_view(audit: DataFrame) -> DataFrame:
    """Exactly decision, message and audit reference: no score, no bank, no threshold."""
    return audit.select(
        "decision",
        rules.customer_message(F.col("decision")).alias("user_message"),
        F.col("transfer_id").alias("audit_ref"),
    )


def evidence(
    refs: DataFrame,
    audit: DataFrame,
    current: DataFrame,
    as_of: Column,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Analyst view of audit references (`audit_ref`): the record and the account's risk now.
    `hot` lists accounts with very many records."""
    recorded = refs.select(F.col("audit_ref").alias("transfer_id")).join(audit, "transfer_id")
    now = lookup(recorded.select("risk_id").distinct(), current, as_of).select(
        "risk_id",
        F.col("lookup_status").alias("status_now"),
        F.col("risk_score").alias("score_now"),
        F.col("contributing_banks").alias("banks_now"),
    )
    return join_to_unique(recorded, now, ["risk_id"], "left", hot, ["transfer_id"])
