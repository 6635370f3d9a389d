"""Operators on a library: items, the subtitles they have, stored runs, and tracks measured by what was heard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.functions import naming
from cuewright.functions.language import normalized
from cuewright.operators.cues import cleaned, timed_tokens
from cuewright.operators.intervals import overlapping
from cuewright.operators.reports import best_tracks, wanted
from cuewright.operators.sync import measured_offset, offset_histogram
from cuewright.scratch import kept

#: Runs that are kept.
KEPT_RUNS = 20
# fixed values: kinds of sources in the order they are listed
KINDS = ("Embedded", "External", "Repaired", "Heard")
#: Cues of a sample; fewest characters of a search; weight of a point from words without times of their own.
SAMPLE_CUES, LEAST_TERM, UNTIMED = 400, 2, 0.5


def eligible(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Items (kind, virtual, has_subtitles, path) that a run visits."""
    return items.where(F.col("kind").isin(kinds) & ~F.col("virtual") & F.col("has_subtitles") & (F.coalesce("path", F.lit("")) != ""))


def searched(items: DataFrame, term: str, limit: int = 30, name: str = "name", key: str = "item_id") -> DataFrame:
    """The first items by name that hold the term, whatever its case; none for a term of one character."""
    low = term.strip().lower()
    rows = items.where(F.lower(name).contains(low) if len(low) >= LEAST_TERM else F.lit(False))
    return rows.orderBy(name, key).limit(min(max(limit, 1), 100))


def _streams(streams: DataFrame, kind: str, names: dict[str, str]) -> DataFrame:
    """Streams (item_id, type, index, ...) of one type; columns that a source lacks are null, a language that is not told is ''."""
    types = {"language": "string", "title": "string", "path": "string", "channels": "int", "index": "int"}
    own = {c: F.col(c) if c in streams.columns else F.lit(None).cast(types.get(c, "boolean")) for c in names}
    told = {c: F.coalesce(x, F.lit("")) if c == "language" else x for c, x in own.items()}
    return streams.where(F.lower("type") == kind).select("item_id", *[told[c].alias(to) for c, to in names.items()])


def subtitle_tracks(streams: DataFrame) -> DataFrame:
    """(item_id, track_idx, language, title, is_text, is_forced, hearing_impaired, external, is_default, path) of the subtitle streams of media files."""
    return _streams(streams, "subtitle", {"index": "track_idx", "language": "language", "title": "title", "is_text": "is_text", "is_forced": "is_forced", "hearing_impaired": "hearing_impaired", "external": "external", "is_default": "is_default", "path": "path"})


def audio_tracks(streams: DataFrame) -> DataFrame:
    """(item_id, audio_idx, audio_language, is_default, channels, title) of the sound streams of media files."""
    return _streams(streams, "audio", {"index": "audio_idx", "language": "audio_language", "is_default": "is_default", "channels": "channels", "title": "title"})


def inventory(tracks: DataFrame, files: DataFrame, repaired: str, heard: str) -> DataFrame:
    """(item_id, place, source_id, kind, stream_idx, lang, is_text, is_forced, path): each item's tracks, and the files beside it that no track is in.

    Tracks: (item_id, track_idx, language, path, is_text, is_forced);
    files: (item_id, path, media). Paths are compared without case.
    """
    named = lambda path: F.regexp_extract(path, r"([^/\\]*)$", 1)
    in_file = F.coalesce("path", F.lit("")) != ""
    listed = tracks.select(
        "item_id", F.concat(F.lit("stream_"), F.col("track_idx").cast("string")).alias("source_id"),
        F.when(in_file, naming.classify(named(F.col("path")), repaired, heard)).otherwise("Embedded").alias("kind"),
        F.col("track_idx").alias("stream_idx"), normalized(F.col("language")).alias("lang"), "is_text", "is_forced", "path",
    )
    seen = tracks.where(in_file).select("item_id", F.lower("path").alias("_low")).distinct()
    name, media = named(F.col("path")), named(F.col("media"))
    beside = files.where(naming.belongs_to(name, media)).withColumn("_low", F.lower("path")).join(seen, ["item_id", "_low"], "left_anti")
    found = beside.select(
        "item_id", naming.file_token(F.col("path")).alias("source_id"), naming.classify(name, repaired, heard).alias("kind"),
        F.lit(None).cast("int").alias("stream_idx"), naming.language_of(name, media).alias("lang"),
        F.lower(naming.extension(name)).isin(naming.EDITABLE).alias("is_text"), F.contains(F.lower(name), F.lit(".forced.")).alias("is_forced"), "path",
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = Window.partitionBy("item_id").orderBy(rank, "lang", F.asc_nulls_last("stream_idx"), "source_id")
    return listed.unionByName(found).select("item_id", F.row_number().over(order).alias("place"), "source_id", "kind", "stream_idx", "lang", "is_text", "is_forced", "path")


def without_language(sources: DataFrame, items: DataFrame, languages: list[str]) -> DataFrame:
    """(item_id, lang) of wanted languages that no text track, but for forced ones, has: those worth transcribing."""
    present = sources.where("is_text and not is_forced").select("item_id", "lang").distinct()
    return wanted(items, languages).join(present, ["item_id", "lang"], "left_anti")


def with_reports(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Sources with the verdict of the stored report of their stream (item_id, stream_idx, verdict), null without one."""
    return sources.join(reports.select("item_id", "stream_idx", "verdict"), ["item_id", "stream_idx"], "left")


def with_verdict(tracks: DataFrame, verdict: str, languages: list[str]) -> DataFrame:
    """Items whose best track of any wanted language has the verdict; without wanted languages, those of which any track has it."""
    rows = best_tracks(tracks).where(F.col("lang").isin(languages)) if languages else tracks
    return rows.where(F.lower("verdict") == verdict.lower()).select("item_id").distinct()


def listed(reports: DataFrame, limit: int = 200, checked: str = "checked_at", key: str = "item_id") -> DataFrame:
    """The newest reports, 1 to 2000 of them."""
    return reports.orderBy(F.desc(checked), F.desc(key)).limit(min(max(limit, 1), 2000))


def recent_runs(runs: DataFrame, live: DataFrame, limit: int = 20, key: str = "run_id", started: str = "started_at") -> DataFrame:
    """The last runs, newest first; one that says it is running but isn't among the live ones was abandoned."""
    last = runs.orderBy(F.desc(started), F.desc(key)).limit(min(max(limit, 1), KEPT_RUNS))
    joined = last.join(live.select(key).distinct().withColumn("_live", F.lit(True)), key, "left")
    status = F.when((F.col("status") == "Running") & F.col("_live").isNull(), "Abandoned").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_live")


def dialogue_sample(cues: DataFrame, most: int = SAMPLE_CUES) -> DataFrame:
    """(track_id, sample): spoken lines from a quarter of each track on, for the language check."""
    lines = cleaned(cues).select("track_id", "cue_idx", "clean")
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("cue_idx")) - 1
    first = F.floor(F.count(F.lit(1)).over(Window.partitionBy("track_id")) / 4)
    chosen = lines.withColumns({"_k": place, "_from": first}).where((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + most))
    return chosen.groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("cue_idx", "clean")))["clean"], " ").alias("sample"))


def heard_points(cues: DataFrame, anchors: DataFrame, heard: DataFrame, most: float = 120.0) -> DataFrame:
    """(track_id, anchor_idx, at_s, offset_s, confidence): each window of a track measured by the words heard in it.

    Anchors: (track_id, anchor_idx, start_s, duration_s, timed); heard: segments
    (track_id, anchor_idx, start_s, end_s, text) on the film's clock. Cues as
    far outside the window as the largest offset count; a window without votes
    gives no point, one heard without times half the confidence.
    """
    key = F.concat_ws("/", F.col("track_id").cast("string"), F.col("anchor_idx").cast("string"))
    windows = anchors.select("track_id", "anchor_idx", F.col("start_s").alias("_a"), (F.col("start_s") + F.col("duration_s")).alias("_b"), "timed", key.alias("window_key"))
    near = overlapping(cues, windows.select("track_id", "window_key", "_a", "_b"), ["track_id"], ("start_s", "end_s"), ("_a", "_b"), max(most, 1.0), most)
    spoken = timed_tokens(near).select("window_key", "word", "at_s")
    said = timed_tokens(heard.withColumn("window_key", key)).select("window_key", "word", "at_s")
    # votes are few and read several times
    votes = kept(offset_histogram(spoken, said, "window_key", most), "votes")
    found = measured_offset(votes, "window_key").where("votes > 0")
    sure = F.when(F.col("timed"), F.col("confidence")).otherwise(F.col("confidence") * UNTIMED)
    return found.join(windows, "window_key").select("track_id", "anchor_idx", ((F.col("_a") + F.col("_b")) / 2).alias("at_s"), "offset_s", sure.alias("confidence"))


def judged_signal(measured: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of measurements (failure, score, anchors) and their assessed fits: a failure is no verdict, no match anywhere a mismatch."""
    own = fits.select(key, F.col("verdict").alias("_own"))
    verdict: Column = F.when(F.col("failure").isNotNull(), "Unknown").when(F.col("score") < 0.25, "Mismatched").when(F.size("anchors") == 0, "Unknown").otherwise(F.coalesce("_own", F.lit("Unknown")))
    return measured.join(own, key, "left").select(key, verdict.alias("verdict"))
