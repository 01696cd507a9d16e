"""From raw publishes to accepted signals and the state of the store."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators import retention, signals, trust
from riskweave.operators.lookup import SignalHistory, hot_accounts
from riskweave.operators.skew import ROWS_PER_TASK


@dataclass(frozen=True)
class PublishResult:
    classified: DataFrame
    quarantined: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return signals.accepted(self.classified)

    @property
    def current(self) -> DataFrame:
        return signals.current_signals(self.accepted)

    def store(self, as_of: Column, max_accounts: int) -> DataFrame:
        return retention.enforce_capacity(self.current, as_of, max_accounts)


def admitted(log: DataFrame, publishers: DataFrame | None = None) -> DataFrame:
    """Valid rows, authenticated where `publishers` are given (rows then carry a `tag`)."""
    valid = signals.valid_signals(log)
    if publishers is None:
        return valid
    checked = trust.verify_payloads(valid, publishers)
    return checked.filter(f"integrity = '{trust.TRUSTED}'").drop("integrity")


def publish(
    log: DataFrame,
    publishers: DataFrame | None = None,
    quota: int | None = None,
    state: signals.StoreState | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> PublishResult:
    """Validate, authenticate and classify a log."""
    valid = admitted(log, publishers)
    # Searched in the raw log, which is cheaper to read; rows refused later only add to a count.
    hot = signals.hot_pairs(log, rows_per_task)
    return PublishResult(
        signals.classify_publishes(valid, quota, hot, state), signals.quarantined_signals(log)
    )


def history_for(
    requests: DataFrame,
    log: DataFrame,
    publishers: DataFrame | None = None,
    quota: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> SignalHistory:
    """The accepted signals of a log, laid out for looking up `requests` (`risk_id, request_ts`).

    Heavy accounts are searched once, over signals and requests together, and the same list splits
    the classification and the lookup.
    """
    hot = hot_accounts(requests, log, rows_per_task)
    classified = signals.classify_publishes(admitted(log, publishers), quota, hot)
    return SignalHistory(signals.accepted(classified), _known_pairs(log, publishers), hot)


def _known_pairs(log: DataFrame, publishers: DataFrame | None) -> DataFrame:
    """At least the (account, bank) pairs of the admitted rows, without checking a tag a second time. Only
    valid rows or banks that were ever registered count, so the banks of an account stay few."""
    if publishers is None:
        return signals.valid_signals(log).select("risk_id", "source_bank_id")
    banks = publishers.select(F.col("bank_id").alias("source_bank_id")).distinct()
    return log.select("risk_id", "source_bank_id").join(banks, "source_bank_id", "left_semi")
