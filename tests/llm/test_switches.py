"""What decides between plans decides nothing else: both sides of each bound give the same rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm import decontaminate, ngram_jaccard, sharding, token_files, url_lists

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "module, bound, query",
    [
        (token_files, "BROADCAST_FILES", token_files.op1_token_ids),
        (decontaminate, "BROADCAST_ROWS", decontaminate.op3_decontaminate),
        (ngram_jaccard, "MOST_COMMON", ngram_jaccard.op4_ngram_jaccard),
        (ngram_jaccard, "BROADCAST_MEMBERS", ngram_jaccard.op4_ngram_jaccard),
        (sharding, "BROADCAST_ROWS", sharding.op6_jump_shards),
        (url_lists, "BROADCAST_ROWS", url_lists.op8_url_lists),
    ],
)
def test_queries(spark, monkeypatch, module, bound, query):
    want = rows(query(spark, DATA))
    monkeypatch.setattr(module, bound, 0)
    assert rows(query(spark, DATA)) == want


def test_the_pipeline_drops_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = docs.where("doc_id % 3 = 0").select("doc_id").union(docs.where("doc_id % 6 = 0").select("doc_id"))
    want = rows(corpus_pipeline._without(docs, ids))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert rows(corpus_pipeline._without(docs, ids)) == want == rows(docs.where(F.col("doc_id") % 3 > 0))
