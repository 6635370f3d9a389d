"""Responses of transcription services as timed segments.

A service is called outside: ``transcribed`` takes any function from audio bytes
to a response body and runs it over a table of clips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions.text import trimmed

# fixed values: why a response has no segments
NOTHING, EMPTY, UNREADABLE = "nothing was said in this window", "the transcriber returned an empty response", "the transcriber returned unreadable JSON"
NO_CANDIDATES, NO_SEGMENTS = "the transcriber returned no candidates", "the answer carried no segments"
_SEGMENTS = "array<struct<start:string,end:string,text:string>>"


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _segments(raw: Column) -> Column:
    """Those with text, with numbers; the end not before the start."""
    kept = F.filter(F.transform(raw, lambda s: F.struct(_number(s["start"]).alias("a"), _number(s["end"]).alias("b"), trimmed(F.coalesce(s["text"], F.lit(""))).alias("t"))), lambda s: s["t"] != "")
    return F.transform(kept, lambda s: F.struct(s["a"].alias("start_s"), F.greatest(s["a"], s["b"]).alias("end_s"), s["t"].alias("text")))


def _result(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "language", "timed", "error", F.when(F.col("error").isNull(), F.col("segments")).alias("segments"))


def verbose_json(rows: DataFrame, key: str, body: str = "body", duration: str = "duration_s") -> DataFrame:
    """(key, language, timed, error, segments) of responses with ``language``, ``text`` and ``segments``; text alone is one untimed segment."""
    read = rows.withColumn("j", F.from_json(body, f"language string, text string, segments {_SEGMENTS}")).withColumn("found", _segments(F.coalesce("j.segments", F.array())))
    bare = F.size(F.coalesce("j.segments", F.array())) == 0
    said = trimmed(F.coalesce("j.text", F.lit("")))
    error = F.when(trimmed(F.coalesce(body, F.lit(""))) == "", EMPTY).when(F.col("j").isNull() | ~F.col(body).rlike(r"^\s*\{"), UNREADABLE).when((bare & (said == "")) | (~bare & (F.size("found") == 0)), NOTHING)
    whole = F.array(F.struct(F.lit(0.0).alias("start_s"), F.col(duration).cast("double").alias("end_s"), said.alias("text")))
    return _result(read.select(key, F.col("j.language").alias("language"), (~bare).alias("timed"), error.alias("error"), F.when(bare, whole).otherwise(F.col("found")).alias("segments")), key)


def candidate_json(rows: DataFrame, key: str, body: str = "body", duration: str = "duration_s", hint: str | None = None) -> DataFrame:
    """The same of responses whose first candidate's parts hold the JSON of ``segments``; times are kept inside the clip."""
    envelope = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
    read = rows.withColumn("e", F.from_json(body, envelope)).withColumn("inner", F.array_join(F.coalesce(F.get("e.candidates", F.lit(0))["content"]["parts"]["text"], F.array()), ""))
    read = read.withColumn("j", F.from_json("inner", f"segments {_SEGMENTS}")).withColumn("found", _segments(F.coalesce("j.segments", F.array())))
    total = F.col(duration).cast("double")
    inside = F.transform("found", lambda s: F.struct(F.least(F.greatest(s["start_s"], F.lit(0.0)), total).alias("start_s"), F.least(F.greatest(s["end_s"], F.least(F.greatest(s["start_s"], F.lit(0.0)), total)), total).alias("end_s"), s["text"].alias("text")))
    error = (
        F.when(trimmed(F.coalesce(body, F.lit(""))) == "", EMPTY)
        .when(F.col("e").isNull() | ~F.col(body).rlike(r"^\s*\{"), UNREADABLE)
        .when(F.size(F.coalesce("e.candidates", F.array())) == 0, NO_CANDIDATES)
        .when(trimmed(F.col("inner")) == "", NOTHING)
        .when(F.col("j.segments").isNull(), NO_SEGMENTS)
        .when(F.size("found") == 0, NOTHING)
    )
    language = F.col(hint) if hint else F.lit(None).cast("string")
    return _result(read.select(key, language.alias("language"), F.lit(True).alias("timed"), error.alias("error"), inside.alias("segments")), key)


def transcribed(clips: DataFrame, key: str, call: Callable[[bytes], str], audio: str = "audio") -> DataFrame:
    """(key, body, error): the response of ``call`` to each clip, or why it failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies, errors = [], []
            for data in pdf[audio]:
                try:
                    body, error = call(data), None
                except Exception as e:  # whatever a service raises is the clip's error, not the job's
                    body, error = None, f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
            yield pd.DataFrame({key: pdf[key], "body": bodies, "error": errors})

    return clips.select(key, audio).mapInPandas(run, f"`{key}` {dict(clips.dtypes)[key]}, body string, error string")


def segment_rows(results: DataFrame, key: str, start: str | None = None) -> DataFrame:
    """(key, seg_idx, start_s, end_s, text), moved by the start of the clip if there is one."""
    by = F.col(start) if start else F.lit(0.0)
    rows = results.where("segments is not null").select(key, by.alias("_by"), F.posexplode("segments").alias("seg_idx", "s"))
    return rows.select(key, "seg_idx", (F.col("s.start_s") + F.col("_by")).alias("start_s"), (F.col("s.end_s") + F.col("_by")).alias("end_s"), F.col("s.text").alias("text"))


def pieces(items: DataFrame, key: str, runtime: str, chunk_s: float = 600.0) -> DataFrame:
    """(key, piece_idx, start_s, duration_s): tumbling chunks of 30 to 3600 seconds over each runtime, the last one cut."""
    size = min(max(chunk_s, 30.0), 3600.0)
    count = F.ceil(F.col(runtime) / size).cast("int")
    rows = items.where(F.col(runtime) > 0).select(key, F.col(runtime).alias("_r"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_idx"))
    return rows.select(key, "piece_idx", (F.col("piece_idx") * size).alias("start_s"), F.least(F.lit(size), F.col("_r") - F.col("piece_idx") * size).alias("duration_s"))
