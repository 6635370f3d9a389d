"""Signals, correlation, votes, fits and verdicts: known answers put in and found again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import alignment, cues as cue_ops, reports, signals, sync

from tests import plain_alignment as plain


def film(seed=7, minutes=45):
    rng = np.random.default_rng(seed)
    at, rows = 12.0, []
    while at < minutes * 60:
        at += rng.uniform(10, 35) if rng.random() < 0.04 else 0
        end = at + rng.uniform(0.8, 4.0)
        rows.append((at, end))
        at = end + rng.uniform(0.35, 2.75)
    return np.array(rows)


def subtitles(speech, offset=0.0, scale=1.0, seed=11):
    rng = np.random.default_rng(seed)
    kept = speech[rng.random(len(speech)) > 0.05]
    return np.stack([offset + scale * (kept[:, 0] - rng.uniform(0.05, 0.3, len(kept))), offset + scale * (kept[:, 1] + rng.uniform(0.1, 0.6, len(kept)))], 1)


def direct(audio, cues, lag):
    fa, la = np.flatnonzero(audio)[[0, -1]]
    fc, lc = np.flatnonzero(cues)[[0, -1]]
    lo, hi = max(0, lag, fc, fa + lag), min(len(cues), len(audio) + lag, lc + 1, la + lag + 1)
    if hi - lo < 16:
        return 0.0
    a, c = audio[lo - lag : hi - lag], cues[lo:hi]
    return 0.0 if a.std() == 0 or c.std() == 0 else float(np.corrcoef(a, c)[0, 1])


def test_transform_equals_direct_sum():
    speech = film(minutes=8)
    a, c = plain._bins(speech[:, 0], speech[:, 1], 2500, 0.2), plain._bins(*subtitles(speech, 3.0).T, 2500, 0.2)
    scores = plain.lag_scores(a, c, 100)
    assert np.allclose(scores, [direct(a, c, k) for k in range(-100, 101)], atol=1e-9)
    assert abs((int(np.argmax(scores)) - 100) * 0.2 - 3.0) < 0.41


@pytest.mark.parametrize("offset", [2.5, -4.0, 31.0, -75.0])
def test_offset_is_found(offset):
    speech = film()
    found = plain.measure(speech, subtitles(speech, offset), speech[-1, 1] + 30)
    assert found["score"] > 0.5 and abs(found["offset_s"] - offset) < 0.3 and found["scale"] == 1.0 and len(found["anchors"]) >= 8


def test_rate_is_found_and_named(spark):
    speech = film(minutes=60)
    found = plain.measure(speech, subtitles(speech, 0.0, 23.976 / 25), speech[-1, 1] + 30)
    points = spark.createDataFrame([("x", float(a), float(o), float(c)) for a, o, c in found["anchors"]], "k string, at_s double, offset_s double, confidence double")
    fit = sync.drift_fit(points, "k")
    row = sync.assessed(points, fit, "k", float(speech[-1, 1])).first()
    assert row["frame_rate"] == "25 → 23.976 fps" and row["verdict"] == "Drifting" and abs(row["scale"] - 0.95904) < 1e-5


def test_other_film_and_sparse_tracks_are_refused():
    speech = film()
    assert plain.measure(speech, subtitles(film(seed=99), 0), 0)["score"] < 0.25
    assert "sparse" in plain.measure(speech, np.array([[100.0, 101.0], [1300.0, 1301.0]]), 0)["failure"]
    assert plain.measure(np.zeros((0, 2)), speech, 0)["failure"] and plain.measure(speech, np.zeros((0, 2)), 0)["failure"]


def bins_of(spark, rows):
    return spark.createDataFrame([(k, int(b)) for k, on in rows.items() for b in np.flatnonzero(on)], "k string, bin long")


@pytest.mark.parametrize("block", [None, 256, 1000])
def test_curves_by_blocks_pairs_and_whole(spark, block):
    speech = film(minutes=8)
    a, c = plain._bins(speech[:, 0], speech[:, 1], 2500, 0.2), plain._bins(*subtitles(speech, 3.0).T, 2500, 0.2)
    late = np.concatenate([np.zeros(1500), c[:900]])
    audio, cues = bins_of(spark, {"x": a, "y": a, "only": a}), bins_of(spark, {"x": c, "y": late, "other": c})
    got = {(r["k"], r["lag"]): r["score"] for r in signals.summed_curve(audio, cues, ["k"], 60, block).collect()}
    native = {(r["k"], r["lag"]): r["score"] for r in signals.correlation_curve(audio, cues, ["k"], 60).collect()}
    want = {(k, lag): s for k, x in (("x", c), ("y", late)) for lag, s in zip(range(-60, 61), plain.lag_scores(a, x, 60))}
    assert got.keys() == native.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 and abs(native[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [None, 2048, 5000])
def test_tracks_aligned_as_whole_films(spark, block):
    speech, other = film(minutes=30), film(seed=99, minutes=12)
    tracks = {(1, "late"): subtitles(speech, 31.0), (1, "pal"): subtitles(speech, 0.0, 23.976 / 25), (1, "alien"): subtitles(film(seed=5, minutes=30)), (1, "sparse"): np.array([[100.0, 101.0], [1300.0, 1301.0]]), (2, "early"): subtitles(other, -4.0), (3, "silent film"): subtitles(other), (4, "flat"): subtitles(other)}
    heard = {1: speech, 2: other, 4: np.array([[0.0, 700.0]])}
    rows = lambda table, schema: spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), float(a), float(b)) for k, x in table.items() for a, b in x], schema).repartition(3)
    got = alignment.aligned(rows(heard, "item int, start_s double, end_s double"), rows(tracks, "item int, track string, start_s double, end_s double"), "item", "track", block=block)
    found = {(r["item"], r["track"]): r for r in got.collect()}
    assert found.keys() == tracks.keys()
    for k, cues in tracks.items():
        order = lambda x: x[np.lexsort((x[:, 1], x[:, 0]))]
        want = plain.measure(order(heard.get(k[0], np.zeros((0, 2)))), order(cues), 0.0)
        r = found[k]
        assert (r["failure"], r["scale"]) == (want["failure"], want["scale"]) and abs(r["score"] - want["score"]) < 1e-9 and abs(r["offset_s"] - want["offset_s"]) < 1e-9
        assert np.allclose([tuple(a) for a in r["anchors"]] or np.zeros((0, 3)), want["anchors"] or np.zeros((0, 3)))
    assert len(found[1, "late"]["anchors"]) >= 8 and found[1, "pal"]["scale"] == 23.976 / 25


def test_a_film_of_a_hundred_hours_is_many_tasks(spark):
    base = film(minutes=300)
    hours = np.concatenate([base + 18_000 * k for k in range(20)])
    speech = spark.createDataFrame([(1, float(a), float(b)) for a, b in hours], "item int, start_s double, end_s double")
    cues = spark.createDataFrame([(1, "t", float(a), float(b)) for a, b in subtitles(hours, 7.0)], "item int, track string, start_s double, end_s double")
    row = alignment.aligned(speech, cues, "item", "track", windows=24).first()
    assert abs(row["offset_s"] - 7.0) < 0.3 and row["scale"] == 1.0 and len(row["anchors"]) == 24


@pytest.mark.parametrize("offset", [0.0, 2.0, -3.4, 45.0])
def test_rare_words_vote(spark, offset):
    cues = spark.createDataFrame([(1, i, 600 + 3.0 * i, 601.5 + 3.0 * i, f"word{i} the") for i in range(30)], "track_id int, cue_idx int, start_s double, end_s double, text string")
    tokens = cue_ops.timed_tokens(cues).select("track_id", "word", "at_s")
    row = sync.measured_offset(sync.offset_histogram(tokens, tokens.withColumn("at_s", F.col("at_s") - offset), "track_id", 120.0), "track_id").first()
    assert abs(row["offset_s"] - offset) <= 0.2 and row["confidence"] > 0.95 and row["votes"] == 30


CASES = [
    # name, offsets at 600, 1200, ..., verdict
    ("even", [1.0, 1.0, 1.0, 1.0], "Offset"), ("fine", [0.1, 0.1, 0.1, 0.1], "InSync"), ("two", [1.0, 1.0], "Unknown"), ("one", [2.0], "Offset"),
    ("one fine", [0.1], "InSync"), ("wild", [0.0, 9.0, -7.0, 4.0], "Mismatched"), ("drift", [0.6, 1.2, 1.8, 2.4], "Drifting"),
]


def test_verdicts(spark):
    rows = [(n, 600.0 * (i + 1), o, 0.8) for n, offsets, _ in CASES for i, o in enumerate(offsets)] + [("weak", 600.0, 1.0, 0.1)]
    points = spark.createDataFrame(rows, "k string, at_s double, offset_s double, confidence double")
    found = {r["k"]: r for r in sync.assessed(points, sync.drift_fit(points, "k"), "k", 5400.0).withColumn("repair", sync.should_repair()).collect()}
    assert {k: r["verdict"] for k, r in found.items()} == {n: v for n, _, v in CASES} | {"weak": "Mismatched"}
    assert found["even"]["repair"] and found["drift"]["repair"] and not found["one"]["repair"] and not found["fine"]["repair"]


def test_retiming_undoes(spark):
    cues = spark.createDataFrame([(1, 0, 10.0, 11.0, "a")], "track_id int, cue_idx int, start_s double, end_s double, text string")
    row = cue_ops.retimed(cues, F.lit(4.0), F.lit(2.0)).first()
    assert (row["start_s"], row["end_s"]) == (3.0, 3.5)
    assert cue_ops.retimed(cues, F.lit(4.0), F.lit(0.0)).first()["start_s"] == 6.0


def test_best_track_and_coverage(spark):
    tracks = spark.createDataFrame(
        [(1, 0, "en", "Offset", 900, False, False, None), (1, 1, "eng", "InSync", 10, True, True, None), (1, 2, "en", "InSync", 10, False, True, None), (1, 3, "fr", "InSync", 900, False, False, "image"), (2, 0, "fr", "InSync", 5, False, False, None)],
        "item_id int, track_idx int, language string, verdict string, cue_count int, hearing_impaired boolean, external boolean, skipped string",
    )
    assert {(r["item_id"], r["lang"]): r["track_idx"] for r in reports.best_tracks(tracks).collect()} == {(1, "en"): 2, (2, "fr"): 0}
    covered = reports.coverage(tracks, tracks, ["en", "fr"])
    assert {r["lang"]: r["n"] for r in reports.missing(covered).collect()} == {"en": 1, "fr": 1}
    assert {r["item_id"]: r["covered"] for r in reports.covered_items(covered).collect()} == {1: False, 2: False}


def test_runs(spark):
    done = spark.createDataFrame([(1, 10.0 * i) for i in range(30)] + [(2, 0.0), (2, 10.0)], "run int, at_s double")
    left = {r["run"]: r["seconds_left"] for r in reports.time_left(done, 5, F.lit(290.0), "run").collect()}
    assert left == {1: pytest.approx(50.0), 2: None}
    costs = spark.createDataFrame([(1, i, 150.0) for i in range(4)], "run int, i int, cost_s double")
    assert [r["admitted"] for r in reports.admitted(costs, 300.0, "run", ["i"]).orderBy("i").collect()] == [True, True, False, False]
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "item_id int, version string")
    seen = spark.createDataFrame([(1, "a"), (2, "x"), (3, "")], "item_id int, version string")
    assert sorted(r["item_id"] for r in reports.needs_check(items, seen).collect()) == [2, 4]


@pytest.mark.parametrize(
    "ceiling, log, want",
    [
        (15.0, [10, 10, 10, (10, 2), 10], [True, True, False, True]),  # room again when enough was given back
        (450.0, [150, (150, 150)] * 3 + [150], [True, True, True, False]),
        (450.0, [150, 150, 150, 150], [True, True, True, False]),
        (10.0, [150, (150, 150), 150], [True, False]),
        (300.0, [150, (150, 0), 150, (150, 0), 150], [True, True, True]),
        (0.0, [150, (150, 150)] * 20, [True] * 20),
        (20.0, [-5, (10, 0), 10, 10, 10], [True, True, True, False]),  # never less than nothing is held
    ],
)
def test_budgets(spark, ceiling, log, want):
    rows = [(run, i, float(x[0] if isinstance(x, tuple) else x), float(x[1]) if isinstance(x, tuple) else None) for run in ("a", "b", None) for i, x in enumerate(log)]
    events = spark.createDataFrame(rows, "run string, i int, estimate_s double, actual_s double").repartition(5)
    done = reports.reserved(events, ceiling, "run", ["i"]).collect()
    for run in ("a", "b", None):
        assert [r["admitted"] for r in sorted(done, key=lambda r: r["i"]) if r["run"] == run] == want


def test_stream_of_files(spark, tmp_path):
    from cuewright.streaming.recheck import file_stream, write_cleaned

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n[noise]\n")
    write_cleaned(file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["clean"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Hello"]


def test_windows_without_words_are_no_rows(spark):
    """A recording of 300,000 years has billions of candidate windows; those near a cue are told from its times."""
    far = 1e13
    cues = spark.createDataFrame([("x", 0, 0.06 * far, 0.06 * far + 2, "one two three"), ("x", 1, 0.5 * far, 0.5 * far + 2, "four five"), ("y", 0, 1.0, 2.0, "short"), ("z", 0, 3.0, 100.0, "?")], "track_id string, cue_idx int, start_s double, end_s double, text string")
    got = {(r["track_id"], r["anchor_idx"]): r for r in cue_ops.anchor_windows(cues, F.when(F.col("track_id") == "x", far).otherwise(0.0)).collect()}
    assert {k: r["expected_words"] for k, r in got.items()} == {("x", 0): 3, ("x", 1): 0, ("x", 2): 2, ("x", 3): 0, ("x", 4): 0, ("y", 0): 1, ("z", 0): 0, ("z", 1): 0}
    assert all(got["x", k]["start_s"] - 2 <= at <= got["x", k]["start_s"] + 30 for k, at in ((0, 0.06 * far), (2, 0.5 * far)))
    assert got["x", 1]["start_s"] == 0.05 * far + (far - far * 0.08 - far * 0.05) / 5 and (got["y", 0]["start_s"], got["y", 0]["duration_s"]) == (0.0, 2.0)


def test_films_of_one_block_are_read_once(spark):
    """Twenty tracks of a film, one without a name, in groups of some of them; spans are not written, transforms not longer than asked for."""
    from pathlib import Path

    tables = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("spans-*")}
    speech, before = film(minutes=10), tables()
    tracks = {t: subtitles(speech, float(t or 0)) for t in [*range(19), None]}
    cues = spark.createDataFrame([(None, t, float(a), float(b)) for t, x in tracks.items() for a, b in x] + [(None, 3, None, None)], "item int, track long, start_s double, end_s double")
    heard = spark.createDataFrame([(None, float(a), float(b)) for a, b in speech], "item int, start_s double, end_s double")
    found = {r["track"]: r for r in alignment.aligned(heard, cues, "item", "track").collect()}
    assert found.keys() == tracks.keys() and tables() == before
    for t, x in tracks.items():
        want = plain.measure(speech, x, 0.0)
        assert t == 3 or abs(found[t]["score"] - want["score"]) < 1e-9 and abs(found[t]["offset_s"] - want["offset_s"]) < 1e-9
    assert abs(found[3]["offset_s"] - 3.0) < 0.3
    assert all(b + 2 * s <= signals.transform_size(b, s) <= 1.34 * (b + 2 * s) for b, s in ((22600, 600), (18834, 200), (65536, 600), (1, 1)))


def test_pairs_are_of_runs(spark):
    """Two signals of one run each are one pair, however long: 40,000 bins against 40,000 within 50 of each other would be four million."""
    one = lambda low, high: spark.createDataFrame([("x", float(low), float(high)), ("x", low + 1.0, low + 2.0), (None, 0.0, 9.0)], "k string, start_s double, end_s double")
    audio, cues = signals.marked_runs(one(10, 8010), ["k"], 0.2), signals.marked_runs(one(14, 8014), ["k"], 0.2)
    assert [(r["k"], r["a"], r["b"]) for r in audio.where("k is not null").collect()] == [("x", 50, 40049)]
    assert sorted((r["k"] or "", r["a"], r["b"]) for r in signals.runs(signals.marked(one(10, 8010), ["k"], 0.2), ["k"]).collect()) == sorted((r["k"] or "", r["a"], r["b"]) for r in audio.collect())
    assert {r["score"] for r in signals.runs_curve(audio, cues, ["k"], 50).collect()} == {0.0}


def test_votes_read_each_side_once(spark):
    tokens = spark.createDataFrame([("x", f"w{i}", float(i)) for i in range(9)] + [("x", "often", float(i)) for i in range(7)], "track_id string, word string, at_s double")
    votes = sync.offset_histogram(tokens, tokens.withColumn("at_s", F.col("at_s") - 1.0), "track_id", 30.0)
    assert votes._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    assert [(r["bin"], r["votes"]) for r in votes.collect()] == [(5, 9)]
