"""Cases that the operators define, one by one: clashing names, repeated and null rows, ids without a piece."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm.byte_bpe import decode_ids, encode_texts
from cuewright.llm.multi_index import nearest
from cuewright.llm.token_files import read_token_ids, write_token_ids
from cuewright.llm.toxicity import fit_toxicity
from cuewright.llm.url_lists import match_captures

DATA = "/root/testdata/sf0.001"
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def test_token_files_leave_their_own_names_out(spark, odd, tmp_path):
    clash = odd.withColumns({c: F.lit(-1) for c in ("part", "local_start", "n_tokens", "token_ids", "start", "_before")})
    write_token_ids(clash, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), partitions=3)
    rows = read_token_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert len(rows) == 10 and "score" in rows[0].asDict() and rows[0]["doc_id"] is None
    ends = 0
    for r in rows:
        assert r["start"] == ends and r["n_tokens"] == len(r["token_ids"])
        ends += r["n_tokens"]


def test_ids_and_texts_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", [9], "x"), (2, None, None, None)], "doc_id int, text string, token_ids array<int>, more string")
    rows = encode_texts(docs, MULTI)
    assert sorted(rows.columns) == ["doc_id", "more", "token_ids"]
    back = {r["doc_id"]: r["text"] for r in decode_ids(rows.withColumn("text", F.lit("old")), MULTI).collect()}
    assert back == {1: "a b", 2: ""}
    nulls = spark.createDataFrame([(1, None)], "doc_id int, token_ids array<int>")
    assert decode_ids(nulls, MULTI).first()["text"] == ""
    for bad in (-1, 50_256):
        with pytest.raises(Exception, match="no piece"):
            decode_ids(spark.createDataFrame([(1, [0, bad])], "doc_id int, token_ids array<int>"), MULTI).collect()


def test_repeated_ids_are_one_query(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [2.0, 0.5]), (2, [9.0, 9.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, share=1.0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 2)] and got[0]["score"] == 0.5


def test_repeated_and_null_labels(spark):
    docs = spark.createDataFrame([(k, "vile words here" if k % 3 == 0 else f"fine w{k % 5} words") for k in range(300)], "doc_id long, text string")
    plain = [(k, int(k % 3 == 0)) for k in range(300)]
    odd = plain + [(3, 0), (3, 1), (None, 1), (4, None), (5, None), (999, 1)]
    fits = [fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int").repartition(3)) for rows in (plain, odd)]
    assert (fits[0].weights == fits[1].weights).all() and fits[0].bias == fits[1].bias


def test_a_closing_point_is_part_of_a_host(spark):
    log = spark.createDataFrame([(1, "bad.com", 0, True)], "entry_id long, domain string, at long, listed boolean")
    pages = spark.createDataFrame([(1, "http://bad.com./x", 5), (2, "http://bad.com/x", 5)], "page_id long, url string, fetched_at long")
    assert {r["page_id"]: r["blocked"] for r in match_captures(pages, log).collect()} == {1: False, 2: True}


def test_decontamination_of_odd_rows(spark, odd):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = odd.unionByName(spark.createDataFrame([(50, f"before it. {item} after it.", 1), (51, item, 2), (51, item, 2), (None, item, 3)], "doc_id long, text string, score int"))
    kept = corpus_pipeline.decontamination(spark, rows, DATA)
    # a row without an id has none to be dropped by
    assert sorted((r["doc_id"] or 0, r["score"] or 0) for r in kept.collect()) == sorted([(r["doc_id"] or 0, r["score"] or 0) for r in odd.collect()] + [(0, 3)])
