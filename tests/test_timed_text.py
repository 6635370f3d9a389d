"""Cleaning, parsing, re-segmentation and naming on literal cases."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import language, naming, text
from cuewright.operators import cues as ops
from cuewright.sources import silences, srt, transcripts


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clean_line(spark):
    cases = {
        "[door creaks]": "", "(SIRENS WAILING)": "", "<i>Hello there.</i>": "Hello there.", "{\\an8}Hello there.": "Hello there.",
        "VINCENT: Say what again.": "Say what again.", "- Get out.": "Get out.", "[sighs] I'm tired.": "I'm tired.", "♪ ominous music ♪": "",
        "Subtitles by explosiveskull": "", "www.opensubtitles.org": "", "Turn the music off.": "", "...": "",
        "♪ Let it go, let it go, can't hold it back anymore ♪": "Let it go, let it go, can't hold it back anymore",
    }
    assert column(spark, [*cases, None], text.clean_line) == [*cases.values(), ""]


def test_words_and_wrap(spark):
    assert column(spark, ["Déjà-vu, isn't it? 42", "", None], text.words) == [["deja", "vu", "isnt", "it", "42"], [], []]
    long = "one two three four five six seven eight nine ten"
    assert column(spark, ["short", long, "x" * 50], text.wrapped) == ["short", "one two three four five\nsix seven eight nine ten", "x" * 50]


def test_language_codes(spark):
    tags = ["en", "eng", "PT-br", "zh_Hans", "French", "klingon", "", None, "-x"]
    assert column(spark, tags, language.normalized) == ["en", "en", "pt", "zh", "fr", "klingon", "", "", "-x"]
    assert column(spark, ["spa", "", "xx"], language.language_name) == ["Spanish", "untagged", "xx"]
    assert column(spark, ["안녕하세요 저는 학생입니다 그리고 친구가 많아요 정말로", "これは日本語の文章です。とても長いですね、本当に。はい", "这是一个很长的中文句子我们今天去公园散步然后回家吃饭", "short"], language.script) == ["ko", "ja", "zh", None]


def test_identify_and_contradict(spark):
    en = "the dog and you that was with this have not for but what " * 5
    de = "und der die das ist nicht sie mit ich auf ein wir hund " * 5
    docs = spark.createDataFrame([(1, en, "en"), (2, de, "en"), (3, "too short", "en"), (4, en, "xx"), (5, None, None)], "id int, text string, lang string")
    scores = ops.language_scores(docs, "id")
    found = {r["id"]: (r["top_code"], r["contradicted"]) for r in ops.contradictions(docs, scores, "id", "lang").collect()}
    assert found == {1: ("en", False), 2: ("de", True), 3: (None, False), 4: ("en", False), 5: (None, False)}


def test_sidecars(spark):
    names = spark.createDataFrame([("Film.en.srt", "Film.mkv"), ("Film.sdh.cicada-heard.srt", "Film.mkv"), ("Filmy.srt", "Film.mkv"), ("film.SRT", "Film.mkv"), ("Film.en.txt", "Film.mkv"), ("Film.pt-BR.cicada.vtt", "Film.mkv")], "n string, m string")
    rows = names.select(naming.classify(F.col("n"), ".cicada", "cicada-heard"), naming.belongs_to(F.col("n"), F.col("m")), naming.language_of(F.col("n"), F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [("External", True, "en"), ("Heard", True, "sdh"), ("External", False, ""), ("External", True, ""), ("External", False, "en"), ("Repaired", True, "pt")]


def test_srt_forms(spark):
    body = "﻿1\r\n00:00:10,500 --> 00:00:12.000 X1:100\r\nHello\r\n there \r\n\r\n2\r\n01:02 --> 01:01\r\nno hours\r\n3\r\nbad --> 00:00:01\r\nlost\r\n4\n00:01:00,0 --> 00:01:01,0\n42\n\n00:02:00,000 --> 00:02:01,000\nkept\n5"
    files = spark.createDataFrame([("a", body), ("b", None), ("c", "")], "track_id string, content string")
    rows = srt.parsed(files).orderBy("cue_idx").collect()
    assert [(r["track_id"], r["start_s"], r["end_s"], r["text"]) for r in rows] == [("a", 10.5, 12.0, "Hello there"), ("a", 62.0, 62.0, "no hours"), ("a", 120.0, 121.0, "kept")]


def test_silences(spark):
    log = "silence_start: 0\nsilence_end: 4.5 | x\nsilence_start: 9.25\nsilence_start: 10\nsilence_end: 12\n"
    logs = spark.createDataFrame([(1, log, 20.0), (2, "silence_start: 15", 20.0), (3, "", 20.0), (4, None, 0.0), (5, "silence_end: 3\nsilence_start: -1\nsilence_end: 99", 20.0)], "item_id int, log string, duration_s double")
    rows = silences.speech(logs).orderBy("item_id", "span_idx").collect()
    assert [(r["item_id"], r["start_s"], r["end_s"]) for r in rows] == [(1, 4.5, 9.25), (1, 12.0, 20.0), (2, 0.0, 15.0), (3, 0.0, 20.0)]


def test_transcript_responses(spark):
    bodies = [(1, '{"language":"en","text":"hi","segments":[{"start":1,"end":0.5,"text":" hi "},{"start":2,"end":3,"text":" "}]}'), (2, '{"text":"only text"}'), (3, '{"text":" "}'), (4, "nonsense"), (5, None)]
    rows = {r["id"]: r for r in transcripts.verbose_json(spark.createDataFrame([(*b, 30.0) for b in bodies], "id int, body string, duration_s double"), "id").collect()}
    assert [tuple(s) for s in rows[1]["segments"]] == [(1.0, 1.0, "hi")] and rows[1]["timed"]
    assert [tuple(s) for s in rows[2]["segments"]] == [(0.0, 30.0, "only text")] and not rows[2]["timed"]
    assert rows[3]["error"] == transcripts.NOTHING and rows[4]["error"] and rows[5]["error"]


@pytest.mark.parametrize("said,cues", [
    ([(0, 1, "Hello"), (1.2, 2, "there.")], [(0.0, 2.0, "Hello there.")]),
    ([(0, 1, "Done."), (1.2, 2, "Next")], [(0.0, 1.0, "Done."), (1.2, 2.2, "Next")]),
    ([(0, 1, "far"), (2, 2.1, "away")], [(0.0, 1.0, "far"), (2.0, 3.0, "away")]),
    ([(0, 5, "over"), (3, 4, "lap")], [(0.0, 4.0, "over lap")]),
])
def test_transcript_cues(spark, said, cues):
    rows = spark.createDataFrame([(1, i, float(a), float(b), t) for i, (a, b, t) in enumerate(said)], "track_id int, cue_idx int, start_s double, end_s double, text string")
    assert [(r["start_s"], r["end_s"], r["text"]) for r in ops.transcript_cues(rows).orderBy("cue_idx").collect()] == cues


def test_long_segment_is_split_in_proportion(spark):
    line = "This is the first sentence of it. And this one, which is rather longer than the other one was, goes on. Short one here."
    rows = spark.createDataFrame([(1, 0, 0.0, 20.0, line)], "track_id int, cue_idx int, start_s double, end_s double, text string")
    found = ops.transcript_cues(rows).orderBy("cue_idx").collect()
    assert " ".join(r["text"].replace("\n", " ") for r in found) == line
    assert all(a["end_s"] <= b["start_s"] + 1e-9 for a, b in zip(found, found[1:])) and all(r["end_s"] - r["start_s"] <= 7 + 1e-9 for r in found)
