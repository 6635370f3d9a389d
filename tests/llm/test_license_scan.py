"""License scans against a plain version over words, planted notices, and odd rows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuewright.llm.license_scan import LEAST, op13_license_scan, scan_licenses, templates_of
from cuewright.llm.license_texts import NOTICES, PHRASES

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_base(text):
    w = words(text)
    found = [(i, label) for label, phrase in PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def plain_spans(text, templates):
    """All spans: votes of equal k-grams by diagonal, neighbours merged, shares counted."""
    w, out = words(text), []
    for t in templates:
        own, votes = [x.decode() for x in t.words], set()
        for i in range(len(w) - t.width + 1):
            for j in range(len(own) - t.width + 1):
                if w[i : i + t.width] == own[j : j + t.width]:
                    votes.add(i - j)
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= t.slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            met = [(d + j, j) for d in g for j in range(len(own)) if 0 <= d + j < len(w) and w[d + j] == own[j]]
            out.append((t.label, t.exact, min(p for p, _ in met), max(p for p, _ in met) + 1, len({j for _, j in met}) / len(own)))
    return sorted(out, key=lambda s: (s[2], s[0], s[3], s[4]))


def test_base_of_all_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: plain_base(r["text"]) for r in rows}
    got = op13_license_scan(spark, DATA)
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = got.collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want and len(got) == len(rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["n_base"] > 0 for r in got) > 20
    assert all(r["score"] == 1 for r in got if r["n_base"])


def changed(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [w[k], "also"], ["other"]])
    return " ".join(w)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_spans_equal_the_plain_version(spark, broadcast):
    rng, templates = random.Random(7), templates_of()
    filler = "some words of no license the software a copy of this in all copies any person".split()
    rows = [(1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (None, "cc by cc by, CC BY-NC 4.0"), (4, "Éapache license mitlicense mit licenses MIT\nLICENSE"), (5, "gnu general public gnu general public license")]
    for k, (_, notice) in enumerate(NOTICES):
        for share in (0, 0.05, 0.3):
            before = " ".join(rng.choice(filler) for _ in range(rng.randint(0, 20)))
            rows.append((100 + k, f"{before} {changed(rng, notice, share)} {before}"))
    rows.append((900, " ".join(text for _, text in NOTICES) * 3))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, hits string").repartition(3)
    got = scan_licenses(docs, templates, broadcast_positions=broadcast).collect()
    own = lambda rows: sorted(rows, key=str)
    assert own((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]]) for r in got) == own((k, len(words(t)), plain_spans(t, templates)) for k, t in rows)


def test_notices_are_found_with_small_changes(spark):
    rng, found = random.Random(2), defaultdict(int)
    rows = [(k, changed(rng, text, 0.03)) for k, (_, text) in enumerate(NOTICES) if len(text) > 200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        labels = {s["label"] for s in r["spans"] if not s["exact"] and s["share"] >= LEAST}
        found[NOTICES[r["doc_id"]][0] in labels] += 1
    assert found[True] == len(rows)


def test_own_templates_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "One two THREE four"), (2, "five")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in scan_licenses(docs, templates_of([("x", "two three")], [])).collect()}
    assert got == {1: [("x", True, 1, 3, 1.0)], 2: []}
    assert {r["doc_id"]: r["spans"] for r in scan_licenses(docs, []).collect()} == {1: [], 2: []}
    assert scan_licenses(docs.where(F.lit(False))).collect() == []


def test_a_long_text(spark):
    text = "word " * 300_000 + "released under the MIT license " + "word " * 300_000 + "Apache License"
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["label"], s["start"]) for s in row["spans"] if s["exact"]] == [("mit", 300_003), ("apache", 600_005)]
