from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_publish import log_frame, row, T0

from riskweave.operators import retention, signals


def at(hours):
    return F.lit(T0 + timedelta(hours=hours)).cast("timestamp_ntz")


def current(spark, rows):
    return signals.current_signals(signals.accepted(signals.classify_publishes(log_frame(spark, rows))))


def test_purge_counts_accounts_not_signals(spark):
    rows = [
        row(0, account="a", ttl=1), row(0, account="a", bank="BANK-B", ttl=100),
        row(0, account="b", ttl=1), row(0, account="b", bank="BANK-B", ttl=1), row(0, account="c"),
    ]
    store = current(spark, rows)
    assert tuple(retention.purge_counts(store, at(1)).first()) == (5, 3, 1)
    assert retention.purge_expired(store, at(1)).count() == 2
    assert tuple(retention.purge_counts(store.limit(0), at(1)).first()) == (0, 0, 0)


def test_flood_cannot_displace_high_risk(spark):
    flood = [row(0, 1, account=a, ttl=168) for a in "0123456789"]
    rows = [row(0, 95, account="a", ttl=24), row(0, 60, account="b", ttl=24)] + flood
    kept = retention.most_valuable_accounts(current(spark, rows), at(1), 3).collect()
    assert {r.risk_id[0] for r in kept} == {"a", "b", "0"}


def test_capacity_ties_and_expiry(spark):
    rows = [row(0, 50, account=a, ttl=t) for a, t in zip("abcd", (10, 20, 20, 1))]
    store = current(spark, rows)
    kept = {r.risk_id[0] for r in retention.enforce_capacity(store, at(2), 2).collect()}
    assert kept == {"b", "c"}
    assert retention.enforce_capacity(store, at(2), 100).count() == 3


def test_holdings(spark):
    rows = [row(0, account=a) for a in "abc"] + [row(1, bank="BANK-B"), row(2, 10)]
    store = current(spark, rows)
    held = {r.source_bank_id: r.accounts_held for r in retention.holdings(store).collect()}
    assert held == {"BANK-A": 3, "BANK-B": 1}
    assert retention.store_size(store).first()[0] == 3


def test_audit_retention(spark):
    rows = [(f"TXN-{i:04d}", datetime(2024, 1, 1) + timedelta(minutes=i // 2)) for i in range(11)]
    audit = spark.createDataFrame(rows, "transfer_id string, decided_at timestamp_ntz")
    kept = retention.retain_audit(audit, 4)
    assert {r.transfer_id for r in kept.kept.collect()} == {
        "TXN-0010", "TXN-0008", "TXN-0009", "TXN-0006"
    }
    assert kept.dropped == 7 and kept.archived.count() == 7
    everything = retention.retain_audit(audit, 100)
    assert everything.dropped == 0 and everything.kept.count() == 11
    assert everything.archived.count() == 0
    with pytest.raises(ValueError):
        retention.retain_audit(audit, 0)
