"""Numbers, neighbours and doubled pointers of ordered rows, and segments joined by them."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import cues as ops, sequences


def plain_joined(rows):
    """Segments (track, start, idx, end, text) joined one after the other."""
    out, seen = [], {}
    for track, start, _, end, text in sorted(rows, key=lambda r: (r[0], *r[1:])):
        last = out[-1] if out and out[-1][0] == track else None
        if last and start - last[3] <= 0.35 and last[4][-1] not in ".!?。！？" and len(last[4]) + 1 + len(text) <= 84 and end - last[2] <= 7:
            last[3:] = [end, f"{last[4]} {text}"]
        else:
            seen[track] = seen.get(track, -1) + 1
            out.append([track, seen[track], start, end, text])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("chunk", [64, 4096])
def test_joined_segments_equal_the_loop(spark, chunk):
    rng, rows = random.Random(chunk), []
    for track in (1, 2, None):
        at = 0.0
        for k in range(400):
            at += rng.choice([0.0, 0.1, 0.3, 0.3, 0.6]) if rng.random() < 0.9 else 2.0
            end = at + rng.choice([0.0, 0.2, 0.5, 9.0])
            rows.append((track, at, k, end, rng.choice(["a", "bc", "word", "some more words", "end.", "什么？", "x" * 60, "y" * 90])))
            at += rng.choice([0.0, 0.2])
    table = spark.createDataFrame(rows, "track_id long, start_s double, cue_idx int, end_s double, text string")
    # the null track is compared by its number
    got = sorted((0 if r[0] is None else r[0], *r[1:]) for r in ops.joined_segments(table.repartition(5), chunk).collect())
    assert got == sorted(plain_joined([(t or 0, *r) for t, *r in rows]))


def test_one_long_track_without_pauses_in_many_tasks(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("track_id"), (F.col("id") / 10.0).alias("start_s"), F.col("id").cast("int").alias("cue_idx"), ((F.col("id") + 1) / 10.0).alias("end_s"), F.when(F.col("id") % 3 == 0, "ab").otherwise("c").alias("text"))
    got = [tuple(r) for r in ops.joined_segments(rows, 2048).orderBy("seg_idx").collect()]
    assert got == plain_joined([tuple(r) for r in rows.collect()])


def test_numbers_and_neighbours(spark):
    rows = spark.createDataFrame([(k, v) for k in ("a", "b", None) for v in range(50)], "k string, v int").repartition(7)
    listed = sequences.numbered(rows, "k", ["v"])
    assert all(r["v"] == r["idx"] for r in listed.collect()) and listed.count() == 150
    near = sequences.dealt(listed.where("k = 'a'"), 2, 3, chunk=10)
    held = {}
    for r in near.collect():
        held.setdefault(r["chunk"], []).append((r["v"], r["own"]))
    assert sorted(held) == [0, 1, 2, 3, 4, 5] and not any(own for _, own in held[5])
    assert sorted(v for v, _ in held[1]) == list(range(8, 23)) and sorted(v for v, own in held[1] if own) == list(range(10, 20))
    odd = sequences.counted(listed.where("v % 3 = 1"), "k", chunk=8)
    assert all(r["number"] == r["v"] // 3 for r in odd.collect())
    with pytest.raises(ValueError):
        sequences.dealt(listed, 20, chunk=10)


def test_orbits(spark):
    rng = random.Random(3)
    to = {i: i + rng.randint(1, 5) for i in range(500)}
    want, at = set(), 0
    while at is not None and at < 500:
        want.add(at)
        at = to.get(at)
    pointers = spark.createDataFrame([("x", i, j) for i, j in to.items() if j < 500], "k string, idx long, to long")
    got = sequences.orbits(spark.createDataFrame([("x", 0)], "k string, idx long"), pointers, "k")
    assert sorted(r["idx"] for r in got.collect()) == sorted(want) and got.count() == len(want)
    none = sequences.orbits(pointers.where("idx < 0"), pointers.where("idx < 0"), "k")
    assert none.count() == 0
