"""Libraries, settings and tracks measured by what was heard."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import naming
from cuewright.operators import library
from cuewright.settings import Settings, language_list


def test_inventory_lists_each_file_once(spark):
    tracks = spark.createDataFrame([(1, 0, "eng", None, True, False), (1, 1, "fr", "/m/FILM.FR.srt", True, True)], "item_id int, track_idx int, language string, path string, is_text boolean, is_forced boolean")
    files = spark.createDataFrame([(1, "/m/Film.fr.srt", "/m/Film.mkv"), (1, "/m/Film.it.cicada-heard.srt", "/m/Film.mkv"), (1, "/m/Other.srt", "/m/Film.mkv"), (2, "/n/B.sup", "/n/B.mkv")], "item_id int, path string, media string")
    rows = library.inventory(tracks, files, "cicada", "cicada-heard")
    assert [tuple(r) for r in rows.orderBy("item_id", "place").select("item_id", "place", "kind", "lang", "is_text").collect()] == [(1, 1, "Embedded", "en", True), (1, 2, "External", "fr", True), (1, 3, "Heard", "it", True), (2, 1, "External", "", False)]
    gaps = library.without_language(rows, rows, ["en", "fr", "it"])
    assert sorted(map(tuple, gaps.collect())) == [(1, "fr"), (2, "en"), (2, "fr"), (2, "it")]


def test_search_and_runs(spark):
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta alpha"), (3, "Gamma")], "item_id int, name string")
    assert [r["item_id"] for r in library.searched(items, " ALPHA").collect()] == [1, 2] and library.searched(items, "a").count() == 0
    runs = spark.createDataFrame([(1, 10, "Running"), (2, 20, "Running"), (3, 5, "Failed")], "run_id int, started_at int, status string")
    assert {r["run_id"]: r["status"] for r in library.recent_runs(runs, runs.where("run_id = 2"), 2).collect()} == {1: "Abandoned", 2: "Running"}


def test_sample_starts_at_a_quarter(spark):
    cues = spark.createDataFrame([(1, i, f"line {chr(97 + i)}") for i in range(8)], "track_id int, cue_idx int, text string")
    assert library.dialogue_sample(cues, 3).first()["sample"] == "line c line d line e"


def test_heard_windows_give_points(spark):
    cues = spark.createDataFrame([(1, i, 3.0 * i, 3.0 * i + 1.5, f"word{i} the") for i in range(100)], "track_id int, cue_idx int, start_s double, end_s double, text string")
    anchors = spark.createDataFrame([(1, 0, 60.0, 30.0, True), (1, 1, 150.0, 30.0, False), (1, 2, 250.0, 30.0, True)], "track_id int, anchor_idx int, start_s double, duration_s double, timed boolean")
    heard = cues.select("track_id", F.when(F.col("start_s") < 100, 0).otherwise(1).alias("anchor_idx"), (F.col("start_s") - 4).alias("start_s"), (F.col("end_s") - 4).alias("end_s"), "text").where("start_s between 60 and 90 or start_s between 150 and 180")
    rows = {r["anchor_idx"]: r for r in library.heard_points(cues, anchors, heard, 20.0).collect()}
    assert set(rows) == {0, 1} and all(abs(r["offset_s"] - 4.0) <= 0.2 for r in rows.values()) and rows[0]["at_s"] == 75.0
    assert rows[0]["confidence"] > 0.95 and rows[1]["confidence"] == pytest.approx(rows[0]["confidence"] / 2, abs=0.03)


def test_signal_verdicts(spark):
    measured = spark.createDataFrame([(1, "no speech", 0.0, []), (2, None, 0.1, [1.0]), (3, None, 0.6, []), (4, None, 0.6, [1.0])], "k int, failure string, score double, anchors array<double>")
    fits = spark.createDataFrame([(4, "InSync"), (2, "Offset")], "k int, verdict string")
    assert {r["k"]: r["verdict"] for r in library.judged_signal(measured, fits, "k").collect()} == {1: "Unknown", 2: "Mismatched", 3: "Unknown", 4: "InSync"}


def test_settings_and_labels(spark):
    assert Settings().audio_seconds() == 0 and Settings(by_transcript=True).audio_seconds(2) == 300
    assert [Settings(max_concurrency=n).lanes(c) for n, c in ((0, 1), (0, 32), (40, 1))] == [1, 4, 16]
    row = spark.range(1).select(language_list(F.lit("eng, fr;French;;x-y")).alias("l"), naming.file_size(F.lit(86016)).alias("k"), naming.file_size(F.lit(1023)).alias("b"), naming.file_size(F.lit(1310720)).alias("m"), naming.source_label(F.lit("en"), F.lit(True), F.lit(True), F.lit(True), F.lit(False)).alias("s")).first()
    assert (row["l"], row["k"], row["b"], row["m"], row["s"]) == (["en", "fr", "x"], "84 KB", "1023 B", "1.3 MB", "English (forced, SDH)")


def test_every_language_is_told(spark):
    from cuewright.functions.language import PROFILES, SCRIPTS
    from cuewright.operators.cues import language_scores, top_guesses
    from cuewright.plans.derived import _SAID

    rows = spark.createDataFrame([(lang, " ".join([said] * 4)) for lang, said in _SAID], "lang string, text string")
    got = {r["lang"]: r["code"] for r in top_guesses(language_scores(rows, "lang"), "lang", 1).collect()}
    assert len(PROFILES) == 24 and set(got) == set(PROFILES) | {c for c, _ in SCRIPTS}
    assert {lang: code for lang, code in got.items() if lang != code} == {}
