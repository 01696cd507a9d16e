"""Registered queries: one per operator, each over whole tables."""

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import money
from riskweave.functions import policy as rules
from riskweave.functions.accounts import account_reject_reason, normalize_account
from riskweave.functions.policy import PolicyConfig
from riskweave.operators import (
    descent,
    lookup,
    metrics,
    retention,
    scoring,
    shards,
    signals,
    training,
    transfers,
    trust,
)
from riskweave.operators.policies import PolicyTable
from riskweave.plans.decide import Decisions, decide_transfers, identify
from riskweave.plans.experiment import run_experiment
from riskweave.plans.publish import history_for, publish
from riskweave.sources import derived, fraud_csv
from riskweave.sources import model_table as model_store
from riskweave.sources.audit import append_audit, read_audit
from riskweave.sources.shared import fresh_dir, stored
from riskweave.streaming import ingest
from riskweave.streaming.decide import TransferDesk
from riskweave.streaming.publish import SignalStore

QUOTA = 100
CAPACITY = 50
AUDIT_CAPACITY = 100
Query = Callable[[SparkSession, str], DataFrame]


def _text(array: str) -> Column:
    return F.array_join(array, ",").alias(array)


def _classified(spark: SparkSession, sf_dir: str, quota: int | None = None) -> DataFrame:
    return publish(derived.signal_log(spark, sf_dir), quota=quota).classified


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.accepted(_classified(spark, sf_dir))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.current_signals(_accepted(spark, sf_dir))


def _end_of_log(spark: SparkSession, sf_dir: str) -> Column:
    return derived.table(spark, sf_dir, "events").agg(F.max("ts")).scalar()


# Signals ------------------------------------------------------------------------------------------


def pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.raw_accounts(spark, sf_dir)
    return derived.pseudonymiser(spark).with_risk_id(log).select("seq", "risk_id")


def normalize_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("account")
    return derived.raw_accounts(spark, sf_dir).select(
        "seq",
        normalize_account(raw).alias("account_norm"),
        account_reject_reason(raw).alias("reject_reason"),
    )


def signal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = signals.with_violations(derived.messy_signals(spark, sf_dir))
    return checked.select("seq", _text("violations"))


def publisher_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = derived.publishers(spark).drop("inner_pad", "outer_pad")
    log = signals.valid_signals(derived.signal_log(spark, sf_dir))
    return trust.with_publisher(log, ring).select("seq", "trust", "key_id")


def payload_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.tagged_log(spark, sf_dir)
    return trust.verify_payloads(log, derived.publishers(spark)).select("seq", "integrity")


def publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("seq", "outcome")


def publish_outcomes_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, QUOTA).select("seq", "outcome")


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.high_water(_accepted(spark, sf_dir), _end_of_log(spark, sf_dir))


def current_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).withColumn("reason_codes", _text("reason_codes"))


def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.purge_counts(_current(spark, sf_dir), _end_of_log(spark, sf_dir))


def capacity_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.most_valuable_accounts(
        _current(spark, sf_dir), _end_of_log(spark, sf_dir), CAPACITY
    )


def account_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = derived.signal_log(spark, sf_dir).select("risk_id").distinct()
    found = lookup.lookup(accounts, _current(spark, sf_dir), _end_of_log(spark, sf_dir))
    return found.select(
        "risk_id", "lookup_status", "risk_score", "confidence", "source_bank_id",
        _text("contributing_banks"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _current(spark, sf_dir)
    total = retention.store_size(current).select(
        F.lit("*").alias("source_bank_id"), F.col("accounts").alias("accounts_held")
    )
    return retention.holdings(current).unionByName(total)


# Transfers ----------------------------------------------------------------------------------------


def minor_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    amount = (
        F.when(key % 6 == 1, F.concat(price, F.lit("5")))
        .when(key % 6 == 2, F.concat(price, F.lit("000")))
        .when(key % 6 == 3, F.concat(F.lit("Rs "), price))
        .when(key % 6 == 4, F.col("o_totalprice").cast("bigint").cast("string"))
        .otherwise(price)
    )
    priced = derived.table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("amount"))
    minor = F.col("amount_minor")
    return transfers.from_major_units(priced).select(
        "o_orderkey", "amount_reject", "amount_minor",
        money.to_major_units(minor).cast("string").alias("amount_major"),
    )


def transfer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = transfers.with_violations(derived.messy_transfers(spark, sf_dir))
    return checked.select("seq", _text("violations"))


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = transfers.valid_transfers(derived.transfer_requests(spark, sf_dir))
    known, _ = identify(requests, derived.pseudonymiser(spark))
    return lookup.risk_at_transfer(known, history_for(known, derived.signal_log(spark, sf_dir)))


def risk_at_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select(
        "transfer_id", "risk_id", "risk_score", "confidence", "source_bank_id", "model_version",
        _text("reason_codes"), _text("contributing_banks"),
    )


def lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lookup.with_lookup_status(_risk(spark, sf_dir), derived.outages(spark))
    return seen.select("transfer_id", "lookup_status", "risk_score", _text("contributing_banks"))


def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lookup.with_lookup_status(_risk(spark, sf_dir), derived.outages(spark))
    decided = transfers.apply_policy(seen, derived.default_policies(), strict=True)
    return decided.select("transfer_id", "decision")


def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lookup.with_lookup_status(_risk(spark, sf_dir), derived.outages(spark))
    decided = transfers.apply_policy(seen, derived.policies(spark))
    return decided.select(
        "transfer_id", "policy.block_at", "policy.min_banks_to_block", "decision"
    )


def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under a policy that changes with every signup: a version for each instant of one."""
    seen = lookup.with_lookup_status(_risk(spark, sf_dir), derived.outages(spark))
    table = PolicyTable.of(derived.signup_policies(spark, sf_dir))
    return transfers.apply_policy(seen, table).select(
        "transfer_id", "policy.block_at", "policy.min_banks_to_block", "decision"
    )


def failsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with an unknown status or without a score must end in the outage decision."""
    number = F.substring("transfer_id", 5, 8).cast("int")
    seen = lookup.with_lookup_status(_risk(spark, sf_dir)).withColumns(
        {
            "lookup_status": F.when(number % 5 == 1, F.lit("timeout"))
            .when(number % 5 == 2, F.lit("found"))
            .otherwise(F.col("lookup_status")),
            "risk_score": F.when(number % 5 != 2, F.col("risk_score")),
        }
    )
    strict = rules.PolicyVersions.single(PolicyConfig(on_bus_unavailable="block"))
    return transfers.apply_policy(seen, strict).select("transfer_id", "lookup_status", "decision")


def _decisions(spark: SparkSession, sf_dir: str, authenticated: bool = False) -> Decisions:
    requests = transfers.valid_transfers(derived.transfer_requests(spark, sf_dir, retries=True))
    return decide_transfers(
        requests,
        derived.tagged_log(spark, sf_dir) if authenticated else derived.signal_log(spark, sf_dir),
        derived.pseudonymiser(spark),
        derived.policies(spark),
        derived.outages(spark),
        derived.publishers(spark) if authenticated else None,
        QUOTA if authenticated else None,
    )


def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    hot = transfers.hot_transfer_ids(d.requests)
    return transfers.replay_decisions(d.requests, d.audit, hot)


def _stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "audit")
    append_audit(_decisions(spark, sf_dir).audit, path)
    return read_audit(spark, path)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table as written and read back."""
    settings = ("step_up_at", "block_at", "on_bus_unavailable")
    return _stored_audit(spark, sf_dir).withColumns(
        {
            "reason_codes": _text("reason_codes"),
            "contributing_banks": _text("contributing_banks"),
            **{f"policy_{name}": F.col(f"policy.{name}") for name in settings},
        }
    ).drop("policy")


def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retention.retain_audit(_stored_audit(spark, sf_dir), AUDIT_CAPACITY)
    return kept.kept.select(
        "transfer_id", "decided_at", F.lit(kept.dropped).cast("bigint").alias("dropped")
    )


def customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).stored(fresh_dir(spark, "audit")).responses


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_audit(spark, sf_dir)
    refs = transfers.customer_view(stored).filter(F.col("decision") == "block")
    seen = transfers.evidence(refs, stored, _current(spark, sf_dir), _end_of_log(spark, sf_dir))
    return seen.select(
        "transfer_id", "decision", "risk_score", _text("contributing_banks"),
        "status_now", "score_now", _text("banks_now"),
    )


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every transfer decided under the policy and the risk known at its moment. Only signals
    that a registered bank has signed, within its quota, count."""
    return _decisions(spark, sf_dir, authenticated=True).audit.select(
        "transfer_id", "bank_id", "receiver_account", "amount_minor", "risk_id", "decision",
        "lookup_status", "risk_score", "model_version",
        _text("reason_codes"), _text("contributing_banks"), "decided_at",
    )


# Model --------------------------------------------------------------------------------------------

BANKS = 5
SEED = 42
HOLDOUT = 0.2
CAP = 20_000
THRESHOLD = 60
VERSION = "m-test"
RATE = 0.05
SHARES = shards.label_proportions(BANKS, 0.5, SEED)


def fixed_network() -> scoring.Network:
    """A network with weights from a formula, so that SQL can hold the same one."""
    i, j = np.meshgrid(np.arange(4), np.arange(16), indexing="ij")
    return scoring.Network(
        ((i * 7 + j * 3) % 11 - 5) / 10.0,
        (np.arange(16) % 5 - 2) / 10.0,
        ((np.arange(16) * 5) % 7 - 3) / 4.0,
        -0.25,
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.labelled(spark, sf_dir)


def card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the shape of the card table."""
    lines = derived.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.datediff("l_shipdate", F.lit("1990-01-01")).alias("Time"),
        F.col("l_quantity").alias("V1"),
        F.col("l_discount").alias("V2"),
        F.col("l_tax").alias("V3"),
        F.col("l_extendedprice").alias("Amount"),
        (F.col("l_returnflag") == "R").cast("int").alias("Class"),
    )
    rows = fraud_csv.card_rows(lines).frame
    x = F.transform("features", lambda v: F.round(v, 6))
    return rows.withColumn("features", x).select(
        "row_id", "label", "event_time", *[F.col("features")[i].alias(f"x{i}") for i in range(4)]
    )


def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the shape of the mobile-money table, with NaN, infinity and NULL in it."""
    n = F.col("l_partkey")
    lines = derived.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_linenumber").alias("step"),
        F.col("l_returnflag").alias("type"),
        F.when(n % 10 == 1, F.lit(float("nan")))
        .when(n % 10 == 2, F.lit(float("inf")))
        .when(n % 10 == 3, F.lit(float("-inf")))
        .when(n % 10 != 4, F.col("l_extendedprice"))
        .alias("amount"),
        F.col("l_quantity").alias("balance"),
        (F.col("l_returnflag") == "R").cast("int").alias("isFraud"),
        F.lit(1).alias("isFlaggedFraud"),
    )
    rows = fraud_csv.mobile_money_rows(lines).frame
    return rows.select(
        "row_id", "label", "event_time", *[F.col("features")[i].alias(f"x{i}") for i in range(3)]
    )


def card_not_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the shape of the card-not-present table: every number is a feature, text is not."""
    lines = derived.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("isFraud"),
        F.datediff("l_shipdate", F.lit("1990-01-01")).alias("TransactionDT"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_extendedprice")).alias("TransactionAmt"),
        F.col("l_returnflag").alias("card4"),
        F.col("l_suppkey").alias("addr1"),
    )
    rows = fraud_csv.card_not_present_rows(lines, drop=("addr1",)).frame
    return rows.select("row_id", "label", "event_time", *[F.col("features")[i].alias(f"x{i}") for i in range(2)])


def class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = shards.cap_keeping_positives(_lines(spark, sf_dir), CAP, SEED)
    return capped.select("id", "label")


def shard_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.contiguous_shards(_lines(spark, sf_dir), 7, ["id"]).select("id", "shard")


def shard_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["event_micros", "id"]
    return shards.contiguous_shards(_lines(spark, sf_dir), BANKS, order).select("id", "shard")


def shard_label_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.label_skew_shards(_lines(spark, sf_dir), SHARES, SEED).select("id", "shard")


def holdout_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = shards.holdout_split(_lines(spark, sf_dir), HOLDOUT, ["event_micros", "id"])
    return split.select("id", "is_holdout")


def holdout_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.random_holdout(_lines(spark, sf_dir), HOLDOUT, SEED).select("id", "is_holdout")


def holdout_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.pooled_holdout(_lines(spark, sf_dir), HOLDOUT, SEED).select("id", "is_holdout")


def bank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks by supplier, more of them than have a letter; every bank must have rows."""
    numbered = _lines(spark, sf_dir).withColumn("shard", (F.col("supplier") % 8).cast("int"))
    named = shards.with_bank_names(numbered)
    shards.bank_sizes(named, shards.bank_names(8))
    return named.groupBy("bank_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives")
    )


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per bank: its network after a step over all its rows."""
    return training.full_batch_baselines(_lines(spark, sf_dir), fixed_network(), 1, RATE)


def gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of every bank over all its rows, from a common network."""
    rows, net = _lines(spark, sf_dir), fixed_network()
    found = descent.gradients(rows, descent.bank_table(rows, net), descent.shape_of(net))
    exploded = found.select("bank_id", F.posexplode("gradient").alias("k", "value"))
    return exploded.select("bank_id", F.col("k").cast("int").alias("k"), F.round("value", 6).alias("value"))


def full_batch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two federated rounds of two full-batch steps at every bank."""
    done = training.full_batch_rounds(_lines(spark, sf_dir), fixed_network(), 2, 2, RATE)
    return done.network.table(spark).withColumn("value", F.round("value", 6))


def full_batch_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bank alone, as many steps."""
    alone = training.full_batch_baselines(_lines(spark, sf_dir), fixed_network(), 4, RATE)
    return alone.withColumn("value", F.round("value", 6))


def fedavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    averaged = training.weighted_average(_updates(spark, sf_dir))
    return averaged.select("layer", "pos", F.round("value", 6).alias("value"), "n")


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averaged update as saved and loaded by version."""
    path = fresh_dir(spark, "models")
    averaged = training.weighted_average(_updates(spark, sf_dir))
    model_store.save_model(averaged, VERSION, path, {"n_features": 4})
    model_store.save_model(averaged.withColumn("value", F.col("value") + 1), "other", path)
    loaded = model_store.load_weights(spark, VERSION, path)
    return loaded.select(
        "version", "layer", "pos", F.round("value", 6).alias("value"),
        F.get_json_object("meta", "$.n_features").cast("int").alias("n_features"),
    )


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_rows(_lines(spark, sf_dir), fixed_network())
    return scored.select("id", F.round("probability", 6).alias("probability"))


def signal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _lines(spark, sf_dir).withColumn("probability", F.col("score"))
    fields = scoring.signal_fields(known, VERSION)
    return fields.select("id", "risk_score", F.round("confidence", 4).alias("confidence"), "model_version")


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid signals for the accounts of high-scoring rows."""
    scored = scoring.signal_fields(
        _lines(spark, sf_dir).withColumn("probability", F.col("score")), VERSION
    ).select(
        F.col("id").alias("seq"),
        F.col("event_time").alias("arrival_ts"),
        derived.account(F.col("supplier")).alias("account"),
        F.col("bank_id").alias("source_bank_id"),
        "risk_score", "confidence", "model_version",
    )
    out = scoring.publishable_signals(
        scored, derived.pseudonymiser(spark), THRESHOLD, 24, "suspicious_pattern"
    )
    return signals.valid_signals(out).select(
        F.col("seq").alias("id"), "risk_id", "source_bank_id", "risk_score", "model_version",
        "ttl_hours", "timestamp", _text("reason_codes"),
    )


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(_lines(spark, sf_dir), ["bank_id"])


def _metric(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _measured(spark, sf_dir).select("bank_id", F.round(name, 6).alias(name))
    query.__doc__ = f"{name} of the score, per bank."
    return query


def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by direction of the label; those of one class have no metrics but keep their counts."""
    rows = _lines(spark, sf_dir).withColumn(
        "grp", F.concat_ws("/", "bank_id", F.when(F.col("score") > 0.75, "high").when(F.col("label") == 1, "hit").otherwise("miss"))
    )
    measured = metrics.ranking_metrics(rows, ["grp"])
    return measured.select("grp", F.round("auc", 6).alias("auc"), "positives", "rows")


def mean_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AUC over groups of which some have none."""
    groups = degenerate(spark, sf_dir)
    return groups.groupBy(F.substring_index("grp", "/", 1).alias("bank_id")).agg(
        F.round(metrics.mean_ignoring_nan("auc"), 6).alias("mean_auc")
    )


def _training(spark: SparkSession, sf_dir: str) -> tuple[training.Blocks, training.TrainConfig]:
    train = _lines(spark, sf_dir)
    sizes = shards.bank_sizes(train)
    config = training.TrainConfig(rounds=5, local_epochs=2)
    blocks = training.pack_blocks(train, sizes, 4, config)
    return replace(blocks, frame=stored(blocks.frame, "blocks")), config


def fed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after five rounds of federated averaging."""
    return training.federated_rounds(*_training(spark, sf_dir)).network.table(spark)


def local_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every bank trained alone."""
    nets = training.local_baselines(*_training(spark, sf_dir))
    rows = [(bank, *entry) for bank, net in nets.items() for entry in net.entries()]
    return spark.createDataFrame(rows, "bank_id string, layer string, pos int, value double")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every local model and the global one on the pooled holdout."""
    config = training.TrainConfig(rounds=5, local_epochs=2)
    done = run_experiment(_lines(spark, sf_dir), 4, config)
    better = F.lit(done.report["sharing"]["auc"]["raised"])
    return done.measured.withColumn("global_beats_mean_local_auc", better)


# Streams ------------------------------------------------------------------------------------------


STEPS = 3


def _step(seq: str) -> Column:
    """The landing that a row comes with: runs of 50 rows are dealt out, so every landing has gaps that later
    ones fill with older rows."""
    return F.floor(F.col(seq) / 50) % STEPS


def _landings(rows: DataFrame, step: Column, source: str) -> Iterator[DataFrame]:
    """Append `rows` to the files of a source in `STEPS` parts; yields the stream of all so far."""
    for k in range(STEPS):
        rows.filter(step == k).write.mode("append").parquet(source)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(source)


def _streamed_store(spark: SparkSession, sf_dir: str) -> tuple[SignalStore, str]:
    """The tagged log as a stream, authenticated, landed out of order and folded in three steps."""
    base = fresh_dir(spark, "signals")
    log = derived.tagged_log(spark, sf_dir)
    store, ring = SignalStore(spark, f"{base}/store"), derived.publishers(spark)
    for stream in _landings(log, _step("seq"), f"{base}/source"):
        ingest.land_signals(stream, f"{base}/landed", f"{base}/progress", ring).awaitTermination()
        store.advance(ingest.admitted_signals(spark, f"{base}/landed"), QUOTA)
    return store, f"{base}/landed"


def stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the streamed log: a row is judged by what was stored when it landed."""
    return _streamed_store(spark, sf_dir)[0].outcomes().select("seq", "outcome")


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream kept out of the store, and why."""
    kept_out = ingest.quarantined(spark, _streamed_store(spark, sf_dir)[1])
    return kept_out.select("seq", _text("violations"), "integrity")


def stream_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored state after a compaction that purges what expired and keeps the most valuable accounts,
    with the slots each bank then holds."""
    store, _ = _streamed_store(spark, sf_dir)
    store.compact(_end_of_log(spark, sf_dir), CAPACITY)
    kept = store.current().select("risk_id", "source_bank_id", "seq", "risk_score")
    return kept.join(store.holdings(), "source_bank_id")


def stream_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers as a stream in three landings, retries in another landing than the request they repeat:
    what lands first is decided against the accepted log and audited, once."""
    base = fresh_dir(spark, "transfers")
    requests = derived.transfer_requests(spark, sf_dir, retries=True)
    again = F.col("seq") >= derived.RETRY
    step = (F.floor((F.col("seq") % derived.RETRY) / 50) + F.when(again, 1).otherwise(0)) % STEPS
    desk, accepted = TransferDesk(spark, f"{base}/desk"), _accepted(spark, sf_dir)
    for stream in _landings(requests, step, f"{base}/source"):
        ingest.land_transfers(
            stream, derived.pseudonymiser(spark), f"{base}/landed", f"{base}/progress"
        ).awaitTermination()
        landed = ingest.admitted_transfers(spark, f"{base}/landed")
        desk.advance(landed, accepted, derived.policies(spark), derived.outages(spark))
    return desk.audit().select(
        "transfer_id", "decision", "lookup_status", "risk_score", _text("contributing_banks"), "decided_at"
    )


QUERIES: dict[str, Query] = {
    "pseudonymise": pseudonymise,
    "normalize_reject": normalize_reject,
    "signal_violations": signal_violations,
    "publisher_trust": publisher_trust,
    "payload_integrity": payload_integrity,
    "publish_outcomes": publish_outcomes,
    "publish_outcomes_quota": publish_outcomes_quota,
    "high_water": high_water,
    "current_signals": current_signals,
    "purge_counts": purge_counts,
    "capacity_topn": capacity_topn,
    "account_risk": account_risk,
    "holdings": holdings,
    "minor_units": minor_units,
    "transfer_violations": transfer_violations,
    "risk_at_transfer": risk_at_transfer,
    "lookup_status": lookup_status,
    "policy_decision": policy_decision,
    "policy_versions": policy_versions,
    "policy_table": policy_table,
    "failsafe": failsafe,
    "idempotent": idempotent,
    "audit": audit,
    "audit_retention": audit_retention,
    "customer_view": customer_view,
    "evidence": evidence,
    "decide_transfers": decided,
    "card_features": card_features,
    "numeric_features": numeric_features,
    "card_not_present": card_not_present,
    "class_cap": class_cap,
    "shard_contiguous": shard_contiguous,
    "shard_temporal": shard_temporal,
    "shard_label_skew": shard_label_skew,
    "holdout_time": holdout_time,
    "holdout_random": holdout_random,
    "holdout_pooled": holdout_pooled,
    "bank_names": bank_names,
    "fedavg": fedavg,
    "score_rows": score_rows,
    "signal_fields": signal_fields,
    "publishable": publishable,
    "roc_auc": _metric("auc"),
    "pr_auc": _metric("pr_auc"),
    "recall_at_fpr": _metric("recall_at_fpr_0_05"),
    "fpr_at_recall": _metric("fpr_at_recall_0_50"),
    "degenerate": degenerate,
    "mean_metric": mean_metric,
    "model_table": model_table,
    "gradient_step": gradient_step,
    "full_batch_rounds": full_batch_rounds,
    "full_batch_baselines": full_batch_baselines,
    "fed_rounds": fed_rounds,
    "local_baselines": local_baselines,
    "report": report,
    "stream_publish": stream_publish,
    "stream_quarantine": stream_quarantine,
    "stream_compact": stream_compact,
    "stream_decide": stream_decide,
}
