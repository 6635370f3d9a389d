"""Files read as rows with reasons, and written in two phases."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cuewright.operators import repairs
from cuewright.sources import files, srt

ONE = "1\n00:00:01,000 --> 00:00:02,000\n"


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_both_parsers_tell_the_same(spark):
    rng = random.Random(4)
    lines = ["", " ", " ", " x", "1", "42", "123456", "hello", " spaced ", "00:00:01,000 --> 00:00:02.5 X1:3", "01:02 --> 01:01", "bad --> 00:00:01", "00:01:00,0-->00:01:01,0", "1:2:3 --> -1:00 left", " 00:00:05,000 --> 00:00:06,000 ", "a --> b --> c", "\u001cend", "9e1", "+7"]
    bodies = [rng.choice(["", "﻿"]) + rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "track_id int, content string")
    native = {}
    for r in srt.parsed(rows).collect():
        native.setdefault(r["track_id"], []).append((r["cue_idx"], r["start_s"], r["end_s"], r["text"]))
    for k, b in enumerate(bodies):
        assert sorted(native.get(k, [])) == files.cues_of(b), repr(b)


def test_tracks_with_reasons(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    texts = {"a.srt": ONE + "<i>Hi</i>\n\n" + ONE + "HI\n\n" + ONE + "[noise]\n\n" + ONE + "hi\n\n" + ONE + "Bye\n", "deep/b.srt": ONE + "[door]\n", "c.srt": "", "d.txt": ONE + "not listed\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "wide.srt").write_bytes(b"\xff\xfe" + (ONE + "Grüße\n").encode("utf-16-le"))
    (tmp_path / "odd.srt").write_bytes(ONE.encode() + b"caf\xe9\n")
    rows = {os.path.relpath(r["track_id"], tmp_path): r for r in srt.read_tracks(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.srt", "c.srt", "deep/b.srt", "odd.srt", "wide.srt"]
    assert [c["text"] for c in rows["a.srt"]["clean"]] == ["Hi", "Bye"] and len(rows["a.srt"]["cues"]) == 5 and rows["a.srt"]["error"] is None
    assert rows["deep/b.srt"]["error"] == srt.NO_DIALOGUE and len(rows["deep/b.srt"]["cues"]) == 1
    assert rows["c.srt"]["error"] == files.NO_CUES and rows["c.srt"]["cues"] == []
    assert rows["wide.srt"]["clean"][0]["text"] == "Grüße" and rows["odd.srt"]["cues"][0]["text"] == "caf�"
    assert rows["a.srt"]["bytes"] == len(texts["a.srt"]) and isinstance(rows["a.srt"]["modified"], datetime)
    assert srt.read_tracks(spark, str(tmp_path / "c.srt")).count() == 1


def test_files_are_dealt_by_size_and_read_apart(tmp_path):
    for k in range(10):
        (tmp_path / f"{k}.srt").write_text("x" * 100)
    reader = files.Subrip({"path": str(tmp_path), "maxBytes": "250"}).reader(None)
    parts = reader.partitions()
    assert [len(p.listed) for p in parts] == [2] * 5
    (tmp_path / "0.srt").unlink()
    first, second = reader.read(parts[0])
    assert first[4].startswith(files.UNREADABLE) and first[3] == [] and second[4] == files.NO_CUES
    with pytest.raises(FileNotFoundError):
        files.WholeText({"path": str(tmp_path / "none")}).reader(None).partitions()


def test_logs_as_whole_texts(spark, tmp_path):
    from cuewright.sources import silences

    (tmp_path / "film.log").write_text("silence_start: 2\nsilence_end: 4 | x\n")
    files.register(spark)
    logs = spark.read.format("whole_text").option("pattern", "*.log").load(str(tmp_path)).select(F.lit(1).alias("item_id"), F.col("content").alias("log"), F.lit(10.0).alias("duration_s"))
    assert [(r["start_s"], r["end_s"]) for r in silences.speech(logs).orderBy("span_idx").collect()] == [(0.0, 2.0), (4.0, 10.0)]


def test_files_are_written_removed_and_left(spark, tmp_path):
    out, log = tmp_path / "out", str(tmp_path / "log")
    out.mkdir()
    for name in ("theirs.en.srt", "mine.repaired.srt", "old.srt"):
        (out / name).write_text("before")
    rows = [("theirs.en.srt", "x"), ("mine.REPAIRED.srt".lower(), "ä"), ("new/deep.srt", "y"), ("old.srt", None), ("none.srt", None)]
    table = spark.createDataFrame([(str(out / n), c, 1) for n, c in rows] + [(None, "no path", 1)], "path string, content string, done int").repartition(4)
    told = {os.path.relpath(r["path"], out): (r["action"], r["done"], r["message"]) for r in files.apply_edits(table, log, ["repaired"]).collect()}
    assert told == {"theirs.en.srt": ("write", False, files.NOT_OURS), "mine.repaired.srt": ("write", True, None), "new/deep.srt": ("write", True, None), "old.srt": ("delete", True, None), "none.srt": ("delete", False, files.GONE)}
    assert listed(out) == ["mine.repaired.srt", "new/deep.srt", "theirs.en.srt"]
    assert (out / "theirs.en.srt").read_text() == "before" and (out / "mine.repaired.srt").read_bytes() == "ä".encode()
    assert files.apply_edits(table.where("false"), log, []).collect() == []


def test_a_copy_goes_elsewhere_where_it_cannot_be(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    beside, store = str(tmp_path / "file" / "a.repaired.srt"), str(tmp_path / "store" / "a.repaired.srt")
    rows = spark.createDataFrame([(1, beside, "A", store), (2, beside + "2", "B", None), (3, str(tmp_path / "c.repaired.srt"), "C", store)], "track_id int, path string, srt string, fallback string")
    told = {r["track_id"]: r for r in repairs.written(rows, str(tmp_path / "log"), ["repaired"]).collect()}
    assert (told[1]["path"], told[1]["done"]) == (store, True) and (tmp_path / "store" / "a.repaired.srt").read_text() == "A"
    assert not told[2]["done"] and told[2]["message"] and told[2]["path"] == beside + "2"
    assert (told[3]["path"], told[3]["done"]) == (str(tmp_path / "c.repaired.srt"), True) and listed(tmp_path / "store") == ["a.repaired.srt"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def fails(k):
        if k == 70:
            raise ValueError("no content")
        return f"text {k}"

    rows = spark.range(80).repartition(4).select(F.concat(F.lit(f"{tmp_path}/out/"), F.col("id").cast("string"), F.lit(".srt")).alias("path"), fails("id").alias("content"))
    with pytest.raises(Exception):
        files.apply_edits(rows, str(tmp_path / "log"), [])
    assert listed(tmp_path / "out") == []


def test_tracks_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0, 1.0, 2.0, "a"), (1, 1, 3661.25, 3662.0, "b\nc"), (2, 0, 0.5, 0.25, "d")], "track_id int, cue_idx int, start_s double, end_s double, text string")
    told = srt.write_srt(cues, F.lit(str(tmp_path / "out")), str(tmp_path / "log"), []).collect()
    assert all(r["done"] for r in told) and len(told) == 2
    back = srt.read_srt(spark, str(tmp_path / "out")).orderBy("track_id", "cue_idx").collect()
    assert [(os.path.basename(r["track_id"]), r["cue_idx"], r["start_s"], r["end_s"], r["text"]) for r in back] == [("1.srt", 0, 1.0, 2.0, "a"), ("1.srt", 1, 3661.25, 3662.0, "b c"), ("2.srt", 0, 0.5, 0.5, "d")]


def test_edits_are_carried_out_unless_refused_late(spark, tmp_path):
    ours, other = tmp_path / "Film.heard.srt", tmp_path / "Film.en.srt"
    for f in (ours, other):
        f.write_text("before")
    sources = spark.createDataFrame([(1, "a", "Heard", str(ours)), (1, "b", "External", str(other)), (2, "a", "Embedded", None), (3, "a", "Heard", str(tmp_path / "gone.heard.srt"))], "item_id int, source_id string, kind string, path string")
    edits = [(1, "a", "Save", 2, None), (1, "b", "Save", 2, str(tmp_path / "Film.copy.heard.srt")), (2, "a", "Extract", 2, str(other)), (2, "a", "Delete", 0, None), (3, "a", "Delete", 0, None), (1, "c", "Delete", 0, None)]
    asked = spark.createDataFrame([(i, s, a, n, 0.0, 1.0, p) for i, s, a, n, p in edits], "item_id int, source_id string, action string, cues int, offset_s double, scale double, copy_path string")
    contents = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (2, "a", "C")], "item_id int, source_id string, content string")
    told = {(r["item_id"], r["source_id"], r["action"]): (r["done"], r["message"]) for r in repairs.carried_out(sources, asked, contents, str(tmp_path / "log"), ["heard"]).collect()}
    assert told[1, "a", "Save"] == (True, "saved 2 cues to Film.heard.srt") and told[1, "b", "Save"][0]
    assert told[2, "a", "Extract"] == (False, files.NOT_OURS) and told[3, "a", "Delete"] == (False, files.GONE)
    assert not told[2, "a", "Delete"][0] and not told[1, "c", "Delete"][0]
    assert (ours.read_text(), other.read_text(), (tmp_path / "Film.copy.heard.srt").read_text()) == ("A", "before", "B")
