"""The corpus pipeline against a plain version of its stages."""

import base64

import public_tokenizers as P

import corpus_pipeline
from cuewright.llm.secret_scan import _redacted, base_spans, random_spans, token_counter
from cuewright.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.test_near_duplicates import brute

DATA = "/root/testdata/sf0.001"


def test_same_as_plain_stages(spark):
    import tiktoken

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    model = fit_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r["doc_id"]: r["text"] for r in score_toxicity(docs, model).where("score < 0.3").collect()}
    components = brute(list(kept.items()), 5, 80)
    kept = {k: t for k, t in kept.items() if components[k][1] == k}
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {k: t for k, t in kept.items() if not any(i in flat(t) for i in items)}
    assert set(got) <= set(clean) and len(set(clean) - set(got)) <= 1
    count = token_counter(P.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, r in got.items():
        base = base_spans(clean[k])
        text = _redacted(clean[k], sorted(base + random_spans(clean[k], base, count)))
        assert r["token_ids"] == theirs.encode_ordinary(text) and r["n_chars"] == len(text) and r["n_tokens"] == len(r["token_ids"])


def test_stages_take_odd_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, empty):
            found = stage(spark, rows, DATA)
            assert name == "tokens" or found.columns == rows.columns
            if name == "near_duplicates" and rows is odd:
                assert sorted(r["doc_id"] or 0 for r in found.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
            elif name != "decontamination":
                assert found.count() == rows.count()
