"""SubRip files as cues, and cues as SubRip files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cuewright.functions.text import SPACE, clean_line, trimmed
from cuewright.operators.cues import srt_text
from cuewright.sources import files

_TIME = r"^(?:([+-]?[0-9]+):)?([+-]?[0-9]+):([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?|[+-]?[0-9]+\.)(?:" + SPACE + ".*)?$"


def seconds_of(text: Column) -> Column:
    """Seconds of [HH:]MM:SS with a point or a comma; what follows a blank is position data; null for anything else."""
    bare = trimmed(F.regexp_replace(text, ",", "."))
    part = lambda k: F.regexp_extract(bare, _TIME, k)
    hours = F.when(part(1) == "", 0.0).otherwise(part(1).try_cast("double"))
    return F.when(bare.rlike(_TIME), hours * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))


def parsed(files: DataFrame, key: str = "track_id", content: str = "content") -> DataFrame:
    """(key, cue_idx, start_s, end_s, text) of whole SubRip texts.

    A line with an arrow begins a cue, whatever its number; its text ends at a
    blank line or the next arrow; a last line that is a bare number of at most
    five characters is the next cue's number and goes. Cues whose times can't
    be read, or without text, are left out; an end before its start is the start.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "^﻿+", ""), "\r\n|\r", "\n")
    lines = files.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("arrow", F.instr("line", "-->") > 0).withColumn("block", F.sum(F.col("arrow").cast("int")).over(order)).where("block > 0")
    inside = Window.partitionBy(key, "block").orderBy("pos")
    lines = lines.withColumn("open", F.max((~F.col("arrow") & F.col("line").rlike(f"^{SPACE}*$")).cast("int")).over(inside) == 0).where("open")
    body = F.array_sort(F.collect_list(F.when(~F.col("arrow"), F.struct("pos", trimmed(F.col("line")).alias("t")))))
    blocks = lines.groupBy(key, "block").agg(F.max(F.when(F.col("arrow"), F.col("line"))).alias("timing"), body.alias("b")).withColumn("b", F.col("b.t"))
    last = F.element_at("b", -1)
    stray = (F.length(last) <= 5) & last.rlike(r"^[+-]?[0-9]+$")
    blocks = blocks.withColumn("b", F.when((F.size("b") > 0) & stray, F.slice("b", 1, F.size("b") - 1)).otherwise(F.col("b"))).where("size(b) > 0")
    cut = F.instr("timing", "-->")
    times = blocks.withColumns({"start_s": seconds_of(F.substr("timing", F.lit(1), cut - 1)), "end_s": seconds_of(F.substr("timing", cut + 3, F.length("timing")))})
    rows = times.where("start_s is not null and end_s is not null")
    number = F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1
    return rows.select(F.col(key), number.alias("cue_idx"), "start_s", F.greatest("start_s", "end_s").alias("end_s"), F.array_join("b", " ").alias("text"))


#: Why a track with cues has nothing to align.
NO_DIALOGUE = "the track held no dialogue once annotations were removed"


def read_tracks(spark: SparkSession, path: str, pattern: str = "*.srt") -> DataFrame:
    """(track_id, bytes, modified, cues, clean, error): a row for every file of a folder, whether it can be read or not.

    ``clean`` has the cues with dialogue, without one that repeats the line
    before it; ``error`` says why there are none. Nothing is shuffled.
    """
    files.register(spark)
    rows = spark.read.format("subrip").option("pattern", pattern).load(path)
    spoken = F.filter(F.transform("cues", lambda c: c.withField("text", clean_line(c["text"]))), lambda c: c["text"] != "")
    rows = rows.withColumn("_spoken", spoken)
    # lines that repeat the one before them go, also in a row of them
    new = F.filter("_spoken", lambda c, i: (i == 0) | (F.lower(c["text"]) != F.lower(F.get(F.col("_spoken"), i - 1)["text"])))
    error = F.coalesce("error", F.when(F.size("_spoken") == 0, NO_DIALOGUE))
    return rows.select(F.col("path").alias("track_id"), "bytes", "modified", "cues", new.alias("clean"), error.alias("error"))


def read_srt(spark: SparkSession, path: str, pattern: str = "*.srt") -> DataFrame:
    """Cues of every file of a folder; ``track_id`` is the file's path."""
    files.register(spark)
    rows = spark.read.format("subrip").option("pattern", pattern).load(path)
    return rows.select(F.col("path").alias("track_id"), F.inline("cues"))


def write_srt(cues: DataFrame, folder: Column, log: str, markers: list[str]) -> DataFrame:
    """One ``.srt`` file a track under ``folder`` (a column of the track), UTF-8 without a byte order mark; what became of each.

    A file that is there is written over only if its name has one of the markers.
    """
    rows = srt_text(cues).select(F.concat(folder, F.lit("/"), F.col("track_id").cast("string"), F.lit(".srt")).alias("path"), F.col("srt").alias("content"))
    return files.apply_edits(rows, log, markers)
