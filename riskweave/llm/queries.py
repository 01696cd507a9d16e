"""The operators applied to whole tables: one query each, with the digest columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    bilinear_lm,
    bpe_transducer,
    conversations,
    decontamination,
    exact_dedup,
    language_id,
    oracle,
    packing,
    quality,
    sharding,
    simhash_trie,
    spelling,
    token_files,
    toxicity,
)
from riskweave.llm.common import remainder, table
from riskweave.sources.shared import fresh_dir

#: Fixed by the contracts.
END_ID = 2
SEQUENCE_TOKENS = 4096
SHARDS = 8


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(
        table(spark, sf_dir, "documents"),
        fresh_dir(spark, "token-files"),
        public_tokenizers.path("byte_bpe_50k.json"),
        END_ID,
    )
    return token_files.with_crc32(files.documents())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", exact_dedup.text_key().alias("text_sha256"))
    return exact_dedup.exact_dedup(docs, "text_sha256", "doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("n_lines").withColumn("rejected_by", F.array_join("rejected_by", " "))


def op4_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = bilinear_lm.fit(docs.where(~held_out))
    return bilinear_lm.score(docs, model).withColumn("held_out", held_out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    net = toxicity.fit(docs.where("NOT held_out"), labels)
    # Only the text goes into the score; the language picks the threshold of the extra columns.
    scored = toxicity.score(docs.select("doc_id", "lang", "held_out", "text"), net, lang_col="lang")
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", "held_out", "score", predicted.alias("predicted"), "threshold", "rejected")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = language_id.fit(docs.where("NOT held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    # Only the text goes into the prediction.
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_groups(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(
        table(spark, sf_dir, "documents"),
        fresh_dir(spark, "packing"),
        public_tokenizers.path("word_bpe_49k.json"),
        END_ID,
    )
    return packing.pieces(files, SEQUENCE_TOKENS)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.lower(F.hex("text_key")).alias("text_sha256"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), typo_one_in=spelling.ONE_IN)
    return spelling.spelling_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(damaged(table(spark, sf_dir, "conversations")), present="present")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage that the contract fixes; `present` is false for those that it drops."""
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_bilinear_lm": op4_bilinear_lm,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_language_id": op7_language_id,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_decontamination": op11_decontamination,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

ORACLES = {
    "op2_exact_dedup": oracle.EXACT_DEDUP,
    "op3_quality": oracle.QUALITY,
    "op10_sharding": oracle.SHARDING,
    "op11_decontamination": oracle.DECONTAMINATION,
    "op12_spelling": oracle.SPELLING,
    "op13_conversations": oracle.CONVERSATIONS,
}
