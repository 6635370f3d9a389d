"""Operators on changes to subtitle files: repaired copies, and edits that never overwrite what others wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuewright.functions import naming
from cuewright.operators.cues import retimed, srt_text
from cuewright.scratch import kept
from cuewright.sources import files

# fixed value: what is said of a write without cues
NOTHING_SAVED = "that is not a subtitle file that can be read: nothing was saved"
#: Below these, an offset in seconds and a scale's distance from 1 are no change.
NO_OFFSET, NO_SCALE = 1e-6, 1e-9


def is_identity(offset: Column, scale: Column) -> Column:
    return (F.abs(offset) < NO_OFFSET) & (F.abs(scale - 1.0) < NO_SCALE)


def retime_error(offset: Column, scale: Column) -> Column:
    """Why a change of timing is refused, or null: both must be finite numbers, the scale above zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(~(finite(offset) & finite(scale) & (scale > 0)), "that is not a timing change that can be applied")


def repair_path(media: Column, language: Column, impaired: Column, marker: str, beside: Column, fallback: Column) -> Column:
    """Where a repaired copy goes: beside the media where that is allowed, else into the fallback folder; null without a path."""
    name = naming.sidecar_name(F.regexp_extract(media, r"([^/\\]*)$", 1), language, impaired, marker)
    folder = F.regexp_replace(media, r"[/\\]?[^/\\]*$", "")
    return F.when(F.trim(F.coalesce(media, F.lit(""))) != "", F.concat(F.when(beside, folder).otherwise(fallback), F.lit("/"), name))


def repaired(cues: DataFrame, corrections: DataFrame) -> DataFrame:
    """(track_id, path, srt) of the tracks whose cues a correction changes.

    Corrections: (track_id, offset_s, scale, path). A correction that changes
    nothing, one that is refused, a track without cues or a path: no row.
    """
    wanted = corrections.where(F.col("path").isNotNull() & ~is_identity(F.col("offset_s"), F.col("scale")) & retime_error(F.col("offset_s"), F.col("scale")).isNull())
    moved = retimed(cues.join(wanted.select("track_id", "offset_s", "scale"), "track_id"), F.col("offset_s"), F.col("scale"))
    return srt_text(moved).join(wanted.select("track_id", "path"), "track_id").select("track_id", "path", "srt")


def edited(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """(item_id, source_id, action, done, target, message) of asked edits (item_id, source_id, action, cues, offset_s, scale, copy_path).

    ``Save`` and ``Retime`` write over files of our own and write a copy of any
    other; ``Extract`` always writes a copy; ``Delete`` takes files alone.
    ``cues`` counts what would be written: without any, nothing is.
    Sources: (item_id, source_id, kind, path); an edit of none is refused.
    """
    known = sources.select("item_id", "source_id", "kind", F.col("path").alias("_path"), F.lit(True).alias("_known"))
    rows = edits.join(known, ["item_id", "source_id"], "left")
    is_file = F.coalesce("_path", F.lit("")) != ""
    ours = F.col("kind").isin("Heard", "Repaired") & is_file
    writes, name = F.col("action").isin("Save", "Retime", "Extract"), lambda p: F.regexp_extract(p, r"([^/\\]*)$", 1)
    # fixed values: what is said of edits that are refused or done
    refused = (
        F.when(F.col("_known").isNull(), "that subtitle is no longer there")
        .when((F.col("action") == "Retime") & retime_error(F.col("offset_s"), F.col("scale")).isNotNull(), retime_error(F.col("offset_s"), F.col("scale")))
        .when(writes & (F.coalesce("cues", F.lit(0)) == 0), NOTHING_SAVED)
        .when((F.col("action") == "Delete") & ~is_file, "this track lives inside the media file: extract it first")
        .when(~F.col("action").isin("Save", "Retime", "Extract", "Delete"), "that is no edit")
    )
    own = F.col("action").isin("Save", "Retime") & ours
    target = F.when(F.col("action") == "Delete", F.col("_path")).when(own, F.col("_path")).otherwise(F.col("copy_path"))
    said = (
        F.when(F.col("action") == "Delete", F.concat(F.lit("deleted "), name(target)))
        .when(own, F.concat(F.lit("saved "), F.col("cues").cast("string"), F.lit(" cues to "), name(target)))
        .when(F.col("action") == "Extract", F.concat(F.lit("saved as "), name(target)))
        .otherwise(F.concat(F.lit("the original was left alone and a copy was saved as "), name(target)))
    )
    return rows.select("item_id", "source_id", "action", refused.isNull().alias("done"), F.when(refused.isNull(), target).alias("target"), F.coalesce(refused, said).alias("message"))


def carried_out(sources: DataFrame, edits: DataFrame, contents: DataFrame, log: str, markers: list[str]) -> DataFrame:
    """``edited``, with its writes and removals done: (item_id, source_id, action, done, target, message).

    ``contents`` (item_id, source_id, content) has what is to be written; a
    write without it is refused. Files are written and removed in two phases
    (``sources.files``), where a file that isn't ours any more stays as it is.
    """
    decided = edited(sources, edits).join(contents.select("item_id", "source_id", "content"), ["item_id", "source_id"], "left")
    empty = F.col("done") & (F.col("action") != "Delete") & F.col("content").isNull()
    decided = decided.withColumns({"done": F.col("done") & ~empty, "message": F.when(empty, NOTHING_SAVED).otherwise(F.col("message")), "target": F.when(~empty, F.col("target"))})
    decided = kept(decided, "edits")
    told = files.apply_edits(decided.where("done").select(F.col("target").alias("path"), F.when(F.col("action") != "Delete", F.col("content")).alias("content")), log, markers)
    told = told.select(F.col("path").alias("_path"), F.col("done").alias("_done"), F.col("message").alias("_why"))
    met = decided.join(told, decided["target"] == told["_path"], "left")
    return met.select("item_id", "source_id", "action", (F.col("done") & F.coalesce("_done", F.lit(False))).alias("done"), "target", F.coalesce("_why", "message").alias("message"))


def written(repairs: DataFrame, log: str, markers: list[str]) -> DataFrame:
    """(track_id, path, done, message): repaired copies (track_id, path, srt) as files, ``path`` being where each went.

    A column ``fallback`` of ``repairs`` says where a copy goes that can't be
    written beside its film.
    """
    told = files.apply_edits(repairs.withColumn("content", F.col("srt")), log, markers).withColumnRenamed("path", "_path")
    met = repairs.select("track_id", "path").join(told, F.col("path") == F.col("_path"), "left")
    return met.select("track_id", F.coalesce("written", "path").alias("path"), "done", "message")
