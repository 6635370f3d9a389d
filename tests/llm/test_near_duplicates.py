"""The n-gram Jaccard join and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from cuewright.llm import ngram_jaccard
from cuewright.llm.components import connected_components
from cuewright.llm.incidence import folded, parity_sketch, prefix, row_product
from cuewright.llm.kernels import shingles, word_hashes
from cuewright.llm.ngram_jaccard import jaccard_components


def sets_of(rows, width):
    found = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found[key] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return found


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    root, links = {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), links[k]) for k in sets}


def corpus(seed=3):
    """Copies, chains of edits that drift apart, a shared passage, sizes around the bound."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "é"] * 20
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, out = text(40), []
    for _ in range(40):
        base = text(rng.choice([1, 2, 3, 8, 12, 30, 60, 120]))
        out.append(base)
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(base)
    out += [text(rng.randint(3, 30)) + passage for _ in range(25)]
    for n in range(90, 101):
        out.append([f"z{i}" for i in range(n)])
    rng.shuffle(out)
    return [(i, (" " if i % 3 else "\n\t ").join(w).upper() if i % 5 == 0 else " ".join(w)) for i, w in enumerate(out)] + [(9000, None), (9001, ""), (9002, " \n ")]


@pytest.mark.parametrize("width,percent,parts", [(3, 90, False), (5, 80, False), (2, 60, True)])
def test_same_as_brute_force(spark, monkeypatch, width, percent, parts):
    if parts:  # columns and blocks of more than a few rows are cut
        monkeypatch.setattr(ngram_jaccard, "COLUMN_ROWS", 3)
        monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 4)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_components(df, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_repeated_rows_and_empty_tables(spark, odd, empty):
    rows = jaccard_components(odd, width=3, percent=90).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert [r["component_id"] for r in rows] == [1, 2, 3, 4, 4, 4, 6, 7, 8]
    assert jaccard_components(empty).count() == 0


def test_prefixes_of_linked_rows_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(85, 101)], rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            hot = np.sort(rng.choice(a, 30, replace=False))
            assert len(np.intersect1d(prefix(a, hot, 80), prefix(b, hot, 80)))
        percent = int(rng.choice([80, 90]))
        w = min(len(parity_sketch(a, percent)), len(parity_sketch(b, percent)))
        differ = int(np.bitwise_count(folded(parity_sketch(a, percent), w) ^ folded(parity_sketch(b, percent), w)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_product_counts_overlaps():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60 if i < 20 else 5000, rng.integers(1, 50)).astype(np.uint64)) for i in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in rows] for a in rows]
    assert (row_product(rows, columns_at_once=16) == np.array(want)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100} | {k: 200 for k in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_long_texts_are_whole():
    text = "ab Cd\x0bef " * 50_000
    assert (word_hashes(text, most=1000) == word_hashes(text)).all() and len(shingles(word_hashes(text), 3)) == 3
