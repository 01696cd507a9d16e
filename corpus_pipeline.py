"""From raw documents to packed sequences: the training-data operators as one pipeline.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before has kept, and returns a
DataFrame; `run` writes each result under the shared folder and reads it back for the next stage. All but
the last stage return the columns of the documents they are given.

1. language: texts without a letter, texts whose most likely language has a posterior under
   `SURE_OF_LANGUAGE`, and texts far less likely per character than others of that language (another
   language, or none: `language_id.ordinary`) go.
2. toxicity: texts at or over the toxicity threshold of their language go.
3. exact dedup: of equal texts the row with the largest doc_id stays.
4. near dedup: of texts linked by their SimHash fingerprints the row with the smallest doc_id stays.
5. packing: what is left, cut into sequences of 4,096 tokens; a row per piece.

Nulls and repeated rows are handled as the operators state. A null text has no letter and goes first.
Columns of the documents keep their values also where an operator adds one of the same name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import exact_dedup, language_id, packing, simhash_trie, token_files, toxicity
from riskweave.llm.common import free_workers, fresh_name, stored, table
from riskweave.llm.queries import END_ID, SEQUENCE_TOKENS
from riskweave.sources.shared import fresh_dir

#: Posterior of the language, with equal priors. Ordinary prose has nearly 1.
SURE_OF_LANGUAGE = 0.5


def set_aside(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns renamed that an operator would replace, and the way back."""
    back = {}
    for name in docs.columns:
        if name.lower() in added:
            back[fresh_name(docs, name)] = name
            docs = docs.withColumnRenamed(name, fresh_name(docs, name))
    return docs, back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_workers(spark)
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    apart, back = set_aside(docs, "lang_pred", "score")
    rate, usual = fresh_name(apart, "rate"), fresh_name(apart, "usual")
    named = stored(language_id.predict(apart, model, rate_col=rate), "languages")
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE_OF_LANGUAGE)
    kept = language_id.ordinary(named, rate, usual).where(sure & F.col(usual))
    return kept.select(*apart.columns).withColumnsRenamed(back)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_workers(spark)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    apart, back = set_aside(docs, "score", "threshold", "rejected")
    scored = toxicity.score(apart, net, lang_col="lang").where("NOT rejected")
    return scored.select(*apart.columns).withColumnsRenamed(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_workers(spark)
    apart, back = set_aside(docs, "keep_id", "group_size", "kept")
    key = fresh_name(apart, "text_key")
    marked = exact_dedup.exact_dedup(apart.withColumn(key, exact_dedup.text_key()), key, "doc_id").where("kept")
    return marked.select(*apart.columns).withColumnsRenamed(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_workers(spark)
    return simhash_trie.one_of_each_group(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_workers(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files = token_files.write_token_files(docs, fresh_dir(spark, "packing"), tokenizer, END_ID)
    return packing.pieces(files, SEQUENCE_TOKENS)


STAGES = [
    ("language", identify_language),
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The trained stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
