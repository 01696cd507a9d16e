"""The pipeline: each stage on what the one before kept."""

from pathlib import Path

import corpus_pipeline
import pyarrow.parquet as pq
from test_llm_groups import plain_components, plain_fingerprint
from test_llm_tokens import check_packed

from riskweave.llm.common import stored


def test_stages_one_after_another(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "exact_dedup", "near_dedup", "packing"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), "t")
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        kept[name], docs = out.collect(), out
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    tested = [r["doc_id"] for r in kept["language"] if labels.get(r["doc_id"]) == 0]
    stayed = {r["doc_id"] for r in kept["toxicity"]}
    assert sum(i in stayed for i in tested) >= 0.95 * len(tested)
    texts = {}
    for r in kept["toxicity"]:
        texts.setdefault(r["text"], []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == sorted(max(ids) for ids in texts.values())
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in kept["exact_dedup"]]
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == sorted(set(plain_components(rows)))
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir), "t").collect()
    check_packed(packed, [(r["doc_id"], r["text"]) for r in kept["near_dedup"]])


def test_intermediate_texts_take_little_room(spark, edge_docs):
    files = [Path(f.removeprefix("file:")) for f in stored(edge_docs, "t").inputFiles()]
    read = [pq.ParquetFile(f).metadata for f in files]
    columns = [m.row_group(0).column(k) for m in read for k in range(m.num_columns) if m.num_row_groups]
    assert columns and {c.compression for c in columns} == {"ZSTD"}


def test_pipeline_edges(spark, edge_docs, no_docs, sf_dir):
    for start in (edge_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "t")
            assert docs.columns == start.columns and docs.exceptAll(start).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
