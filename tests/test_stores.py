"""The report store, the run log, listings of files, and the stream that keeps their versions."""

import glob
import os
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuewright.operators import library
from cuewright.plans.queries import QUERIES
from cuewright.sources import inventory, runs, store
from cuewright.streaming import recheck

SCHEMA = "item_id long, checked_at long, verdict string"
DAY = datetime(2024, 5, 1)


def reports(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path):
    return {r["item_id"]: (r["checked_at"], r["verdict"]) for r in store.stored_reports(spark, path, SCHEMA).collect()}


def test_a_store_is_updated_by_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    assert held(spark, path) == {}
    store.save_reports(reports(spark, [(k, 1, "a") for k in range(100)]), path, buckets=8)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/slot=*/*.parquet")}
    assert len(before) == 8
    listed = store.stored_reports(spark, path, SCHEMA)
    listed.count()
    store.save_reports(reports(spark, [(7, 2, "b"), (500, 2, "new"), (3, 0, "older"), (None, 5, "no item")]), path, buckets=8)
    assert held(spark, path) == {k: (1, "a") for k in range(100)} | {7: (2, "b"), 500: (2, "new"), None: (5, "no item")}
    after = set(glob.glob(f"{path}/bucket=*/slot=*/*.parquet"))
    # other buckets are as they were, and what a reader had listed is still there
    assert set(before) <= after and len(after) <= 8 + 4 and all(os.path.getmtime(f) == t for f, t in before.items())
    assert {r["item_id"]: r["verdict"] for r in listed.collect()} == {k: "a" for k in range(100)}
    for n in range(3, 9):
        store.save_reports(reports(spark, [(7, n, f"v{n}")]), path, buckets=8)
    assert len(glob.glob(f"{path}/bucket=*/slot=*/*.parquet")) <= 16 and held(spark, path)[7] == (8, "v8")


def test_what_is_no_report_is_skipped(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save_reports(reports(spark, [(k, 1, "a") for k in range(20)]), path, buckets=2)
    (tmp_path / "store" / "bucket=0" / "slot=0" / "part-x.parquet").write_bytes(b"half a report")
    assert len(held(spark, path)) == 20
    assert store.clear_reports(spark, path, SCHEMA) == 20 and held(spark, path) == {}


def test_runs_are_the_sum_of_their_events(spark, tmp_path):
    path = str(tmp_path / "runs")
    at = lambda minutes: DAY + timedelta(minutes=minutes)
    for k in range(3):
        runs.begin(spark, path, f"2024050{k}", at(k * 60), "schedule", 10)
    items = [("20240500", at(1), "a", 2, 60.0, 0.5, None), ("20240500", at(2), "b", 1, 30.0, None, None), ("20240501", at(61), "c", 0, 0.0, None, "lost"), *[("20240502", at(121 + k), f"d{k}", 1, 6.0, None, None) for k in range(5)]]
    table = spark.createDataFrame([(r, t, i, c, s, None if p is None else str(p), e) for r, t, i, c, s, p, e in items], "run_id string, at timestamp, item_id string, clips int, audio_s double, cost string, error string")
    runs.finished(table, path)
    assert runs.end(spark, path, "20240500", at(5), "Completed") == []
    with pytest.raises(ValueError):
        runs.end(spark, path, "20240501", at(5), "Lost")
    live = spark.createDataFrame([("20240502",)], "run_id string")
    found = [(r["run_id"], r["status"], r["items"], r["failed"], r["minutes"], None if r["cost"] is None else float(r["cost"]), r["planned"]) for r in runs.recent(spark, path, live).orderBy(F.desc("started_at")).collect()]
    assert found == [("20240502", "Running", 5, 0, 0.5, None, 10), ("20240501", "Abandoned", 1, 1, 0.0, None, 10), ("20240500", "Completed", 2, 0, 1.5, 0.5, 10)]
    left = {r["run_id"]: r["seconds_left"] for r in runs.progress(spark, path, at(125)).collect()}
    assert left["20240502"] == pytest.approx(5 / (4 / 240.0)) and left["20240501"] is None
    assert runs.recent(spark, path, live, 1).count() == 1


def test_the_oldest_runs_go(spark, tmp_path):
    path = str(tmp_path / "runs")
    begun = spark.range(22).select(F.format_string("r%02d", "id").alias("run_id"), F.lit(DAY).alias("at"), F.lit("begin").alias("kind"))
    runs.append(begun, path)
    assert runs.end(spark, path, "r21", DAY, "Failed", "why") == ["r01", "r00"]
    assert runs.runs(spark, path).count() == library.KEPT_RUNS and runs.rotate(spark, path) == []


def test_listing_opens_no_file(spark, tmp_path):
    for name in ("a/Film.mkv", "a/Film.en.srt", "a/Film.fr.srt", "a/notes.txt", "b/Other.mkv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    rows = inventory.listed_files(spark, str(tmp_path), "*.srt")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema", 1)[1]
    found = {os.path.basename(r["path"]): r for r in rows.collect()}
    assert sorted(found) == ["Film.en.srt", "Film.fr.srt"] and found["Film.en.srt"]["bytes"] == 13
    modified = os.path.getmtime(tmp_path / "a/Film.en.srt")
    size, ticks = found["Film.en.srt"]["version"].split("-")
    assert size == "13" and abs(int(ticks) / 1e7 - 62_135_596_800 - modified) < 0.01
    items = spark.createDataFrame([(1, str(tmp_path / "a/Film.mkv")), (2, str(tmp_path / "b/Other.mkv"))], "item_id int, media string")
    near = inventory.beside(inventory.listed_files(spark, str(tmp_path)), items).collect()
    assert sorted((r["item_id"], os.path.basename(r["path"])) for r in near) == [(1, "Film.en.srt"), (1, "Film.fr.srt"), (1, "notes.txt")]
    # against stored versions: the same, an older one, none, a file that is gone
    movies = spark.createDataFrame([(1, str(tmp_path / "a/Film.mkv")), (2, str(tmp_path / "b/Other.mkv")), (3, str(tmp_path / "c.mkv")), (4, str(tmp_path / "a/notes.txt"))], "item_id int, path string")
    now = {r["path"]: r["version"] for r in inventory.listed_files(spark, str(tmp_path)).collect()}
    stored = spark.createDataFrame([(1, now[str(tmp_path / "a/Film.mkv")]), (2, "1-1"), (4, "")], "item_id int, version string")
    assert sorted(r["item_id"] for r in inventory.due(spark, movies, str(tmp_path), stored).collect()) == [2, 3]


def test_a_stream_tells_changes_once(spark, tmp_path):
    source, out, place = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def batch(*rows):
        spark.createDataFrame([(k, v, DAY + timedelta(hours=h)) for k, v, h in rows], "item_id string, version string, seen_at timestamp").coalesce(1).write.mode("append").parquet(source)

    def told():
        stream = spark.readStream.schema("item_id string, version string, seen_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = recheck.write_changed(stream, out, place, delay="2 hours", forget_s=10 * 3600)
        query.awaitTermination()
        return sorted(((r["item_id"], r["version"], r["change"]) for r in spark.read.parquet(out).collect()), key=str)

    batch(("a", "1", 0), ("a", "2", 1), ("b", "1", 0), ("c", None, 0), (None, "1", 0))
    first = told()
    assert first == sorted([("a", "2", "new"), ("b", "1", "new"), ("c", "", "new"), (None, "1", "new")], key=str)
    assert told() == first  # started again: nothing is repeated
    batch(("a", "2", 3), ("b", "9", 3), ("c", "5", 3), ("d", "1", 3))
    second = told()
    assert set(second) - set(first) == {("b", "9", "changed"), ("d", "1", "new")}
    batch(("a", "0", 2), ("b", "9", 4))  # an older sighting counts for nothing
    assert told() == second
    batch(("b", "9", 40))
    batch(("b", "9", 41))
    gone = set(told()) - set(second)
    assert ("a", "2", "gone") in gone and ("d", "1", "gone") in gone and not any(k == "b" for k, *_ in gone)
    batch(("a", "2", 42))
    assert told().count(("a", "2", "new")) == 2


def test_items_share_the_state_of_a_stream(spark, tmp_path):
    source, out, place = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    at = lambda h: DAY + timedelta(hours=h)
    items = [None, 2**53, 2**53 + 1, *range(2997)]

    def told(*rows):
        made = spark.createDataFrame([(k, v, at(h)) for k, v, h in rows], "item_id long, version string, seen_at timestamp")
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        query = recheck.write_changed(stream, out, place, delay="2 hours", forget_s=10 * 3600)
        query.awaitTermination()
        assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 1024
        found = Counter((r["item_id"], r["version"], r["seen_at"], r["change"]) for r in spark.read.parquet(out).collect())
        return len(found - want), len(want - found)

    want = Counter((k, "1", at(0), "new") for k in items)
    assert told(*((k, "1", 0) for k in items)) == (0, 0)
    # of three items one changes, one has an older sighting, one isn't seen
    some = {k: i % 3 for i, k in enumerate(items)}
    want += Counter((k, "2", at(3), "changed") for k in items if some[k] == 0)
    assert told(*((k, "2", 3) if some[k] == 0 else (k, "0", -1) for k in items if some[k] < 2)) == (0, 0)
    # one is seen much later: all others are gone, with what was last known, and new if they come back
    want += Counter((k, "2", at(3), "gone") if some[k] == 0 else (k, "1", at(0), "gone") for k in items if k != 7)
    assert some[7] == 1 and told((7, "1", 40)) == (0, 0)
    want += Counter([(5, "1", at(41), "new")])
    assert told((5, "1", 41)) == (0, 0)
    with pytest.raises(TypeError, match="double"):
        recheck.changed(spark.readStream.schema("item_id double, version string, seen_at timestamp").parquet(source))


def test_sightings_without_a_time_are_no_change(spark, tmp_path):
    spark.createDataFrame([(1, None, 1, "view"), (2, None, None, None)], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["changed_stream"][0](spark, str(tmp_path)).collect() == []


def test_files_seen_by_the_hour(spark, tmp_path):
    texts = [("a", "English text of some words, and more of them", 1), ("b", "これは日本語の文章です。とても長いですね、本当に。はい", 2), ("c", "short", 3), ("late", "short", 0), ("d", "x", 300)]
    for k, (name, text, minutes) in enumerate(texts):
        spark.createDataFrame([(name, text, DAY + timedelta(minutes=minutes))], "track_id string, content string, seen_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track_id string, content string, seen_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = recheck.activity(stream, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = [(r["window"]["start"], r["files"], r["scripted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert found == [(DAY, 4, 1)]  # the last window is still open
