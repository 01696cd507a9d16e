"""Deciding transfers end to end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.accounts import Pseudonymiser
from riskweave.functions.policy import PolicyVersions
from riskweave.operators import lookup, transfers
from riskweave.operators.barrier import computed_once
from riskweave.operators.skew import ROWS_PER_TASK
from riskweave.plans.publish import history_for
from riskweave.sources.audit import append_audit, read_audit


@dataclass(frozen=True)
class Decisions:
    """audit: one record per transfer. responses: one customer row per request, retries included.
    quarantined: requests without a usable receiver account, which get no audit record."""

    audit: DataFrame
    requests: DataFrame
    quarantined: DataFrame
    rows_per_task: int

    def stored(self, path: str) -> Decisions:
        """The same with the audit appended to the table at `path` and read from there, so that what follows
        decides nothing a second time."""
        append_audit(self.audit, path)
        return replace(self, audit=read_audit(self.audit.sparkSession, path))

    @property
    def responses(self) -> DataFrame:
        hot = transfers.hot_transfer_ids(self.requests, self.rows_per_task)
        answered = transfers.replay_decisions(self.requests, self.audit, hot)
        return transfers.customer_view(answered)


def identify(requests: DataFrame, pseudonymiser: Pseudonymiser) -> tuple[DataFrame, DataFrame]:
    """Requests with the pseudonym of their receiver, and those whose receiver is malformed."""
    named = pseudonymiser.with_risk_id(requests, "receiver_account").drop("account_norm")
    named = computed_once(named, "transfers-identified")
    malformed = F.col("account_reject").isNotNull()
    return named.filter(~malformed).drop("account_reject"), named.filter(malformed)


def decide_transfers(
    requests: DataFrame,
    log: DataFrame,
    pseudonymiser: Pseudonymiser,
    policies: PolicyVersions | None = None,
    outages: DataFrame | None = None,
    publishers: DataFrame | None = None,
    quota: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> Decisions:
    """Pseudonymise the receiver, look up its risk as of the request, decide, record.

    `log` is the publish log; it is validated and classified here. The plan shuffles the first
    requests once by transfer, once by (account, bank) with the signal history, and the roll-up
    once by transfer. Only heavy accounts add more.
    """
    usable, malformed = identify(requests, pseudonymiser)
    history = history_for(usable, log, publishers, quota, rows_per_task)
    risk = lookup.risk_at_transfer(transfers.first_requests(usable), history)
    seen = lookup.with_lookup_status(risk, outages)
    decided = transfers.apply_policy(seen, policies or PolicyVersions.single())
    return Decisions(transfers.audit_records(decided), usable, malformed, rows_per_task)
