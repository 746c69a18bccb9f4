"""The pipeline's filter against the labels of the smallest table."""

import corpus_pipeline
from matchlake.llm import quality


def test_words_by_length(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    # a table of junk words, 339 long, that one constant bound lets through
    assert 811 not in kept
    judged = quality.judge(docs, ["doc_id"]).where("not base_failed").select("_row.doc_id")
    good = {r.doc_id for r in labels.join(judged, "doc_id").where("quality = 1").collect()}
    assert len(good) > 300 and len(good - kept) <= len(good) // 100
