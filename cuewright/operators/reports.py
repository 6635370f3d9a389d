"""Operators on reports: best tracks, coverage, gaps, audio choice, runs.

Track rows: (item_id, track_idx, language, verdict, cue_count, hearing_impaired,
external, skipped); ``skipped`` is a reason or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.functions.language import normalized

# fixed values: how good a verdict is
TIERS = {"InSync": 4, "Offset": 3, "Drifting": 2, "Unknown": 1}
#: Completions looked back at, and fewest for an estimate.
LOOK_BACK, LEAST_DONE = 20, 3


def tier(verdict: Column) -> Column:
    found = F.lit(0)
    for name, value in TIERS.items():
        found = F.when(verdict == name, value).otherwise(found)
    return found


def track_verdict(skipped: Column, contradicted: Column, cues: Column, sync: Column) -> Column:
    return F.when(skipped.isNotNull(), "NoDialogue").when(contradicted, "WrongLanguage").when(cues == 0, "NoDialogue").otherwise(F.coalesce(sync, F.lit("Unknown")))


def skip_reason(is_text: Column, forced: Column) -> Column:
    return F.when(~is_text, "pictures, not text").when(forced, "forced lines only")


def tracks_in(tracks: DataFrame, languages: list[str], language: str = "language") -> DataFrame:
    """Tracks in one of the wanted languages; all of them if none is wanted."""
    codes = tracks.sparkSession.createDataFrame([(x,) for x in languages], "want string").select(normalized(F.col("want")).alias("_want")).where("_want <> ''").distinct()
    rows = tracks.withColumn("_want", normalized(F.col(language)))
    return rows.join(F.broadcast(codes), "_want", "left_semi").drop("_want") if languages else tracks


def by_audio(subtitles: DataFrame, audio: DataFrame) -> DataFrame:
    """(item_id, audio_idx, tracks, n): the subtitle tracks that are measured against one audio stream, so that it is heard once."""
    chosen = chosen_audio(subtitles, audio)
    return chosen.groupBy("item_id", "audio_idx").agg(F.array_sort(F.collect_list("track_idx")).alias("tracks"), F.count(F.lit(1)).alias("n"))


def best_tracks(tracks: DataFrame) -> DataFrame:
    """The best track of each item and language: by verdict, cues, not for the hearing-impaired, embedded, index."""
    rows = tracks.where("skipped is null").withColumn("lang", normalized(F.col("language"))).where("lang <> ''")
    order = Window.partitionBy("item_id", "lang").orderBy(F.desc(tier(F.col("verdict"))), F.desc("cue_count"), "hearing_impaired", "external", "track_idx")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def wanted(items: DataFrame, languages: list[str]) -> DataFrame:
    """(item_id, lang) of every item and wanted language; the languages are a setting, within each row."""
    return items.select("item_id").distinct().withColumn("lang", F.explode(F.array_distinct(F.array(*[F.lit(x) for x in languages]))))


def coverage(tracks: DataFrame, items: DataFrame, languages: list[str]) -> DataFrame:
    """(item_id, lang, verdict): the best track's verdict of each wanted language, null where there is none."""
    best = best_tracks(tracks).select("item_id", "lang", "verdict")
    return wanted(items, languages).join(best, ["item_id", "lang"], "left")


def by_verdict(covered: DataFrame) -> DataFrame:
    return covered.where("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def audio_minutes(reports: DataFrame, seconds: str = "audio_s", cost: str | None = None) -> DataFrame:
    """(items, minutes[, cost]) of all reports; minutes are 0 without any, the cost is null if no report has one."""
    sums = [F.sum(F.col(cost)).alias("cost")] if cost else []
    return reports.agg(F.count(F.lit(1)).alias("items"), (F.coalesce(F.sum(seconds), F.lit(0.0)) / 60.0).alias("minutes"), *sums)


def missing(covered: DataFrame) -> DataFrame:
    return covered.where("verdict is null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def covered_items(covered: DataFrame) -> DataFrame:
    """(item_id, covered): whether the best track of every wanted language is in sync."""
    return covered.groupBy("item_id").agg(F.bool_and(F.coalesce(F.col("verdict") == "InSync", F.lit(False))).alias("covered"))


def missing_tracks(tracks: DataFrame, items: DataFrame, languages: list[str]) -> DataFrame:
    """(item_id, lang) of wanted languages that no readable track with cues is tagged as; a track in a wrong language counts as present."""
    present = tracks.where("skipped is null and cue_count > 0").select("item_id", normalized(F.col("language")).alias("lang")).distinct()
    return wanted(items, languages).join(present, ["item_id", "lang"], "left_anti")


def chosen_audio(subtitles: DataFrame, audio: DataFrame) -> DataFrame:
    """The audio stream of each subtitle track: one of its language if there is any, default ones first, then by channels and index."""
    rows = subtitles.select("item_id", "track_idx", normalized(F.col("language")).alias("want")).join(audio, "item_id")
    match = (F.col("want") != "") & (normalized(F.col("audio_language")) == F.col("want"))
    order = Window.partitionBy("item_id", "track_idx").orderBy(F.desc(match), F.desc("is_default"), F.desc("channels"), "audio_idx")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("item_id", "track_idx", "audio_idx")


def latest(reports: DataFrame, key: str, *order: str) -> DataFrame:
    """The last report of each key; equal times go to the later of the other columns."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return reports.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def needs_check(items: DataFrame, stored: DataFrame, key: str = "item_id") -> DataFrame:
    """Items never checked, or stored under another version; a report without a version counts as current."""
    known = stored.select(key, F.col("version").alias("_seen"))
    due = F.col("_known").isNull() | ((F.coalesce("_seen", F.lit("")) != "") & (F.col("_seen") != F.col("version")))
    return items.join(known.withColumn("_known", F.lit(True)), key, "left").where(due).select(items.columns)


def time_left(completions: DataFrame, remaining: Column | int, now: Column, key: str, at: str = "at_s") -> DataFrame:
    """(key, seconds_left) at the rate of the last 20 completions up to ``now``; null while unknown, 0 when nothing remains."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    recent = completions.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= LOOK_BACK)
    todo = remaining if isinstance(remaining, Column) else F.lit(remaining)
    found = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.first(now).alias("now"), F.first(todo).alias("todo"))
    span = F.col("now") - F.col("first")
    left = F.when(F.col("todo") <= 0, 0.0).when((F.col("n") >= LEAST_DONE) & (span > 0), F.col("todo") / ((F.col("n") - 1) / span))
    return found.select(key, left.alias("seconds_left"))


def admitted(costs: DataFrame, ceiling: float, key: str, order: list[str], cost: str = "cost_s") -> DataFrame:
    """Rows with ``admitted``: whether what was spent before stays below the ceiling; none or a negative one admits all."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.greatest(F.col(cost), F.lit(0.0))).over(before), F.lit(0.0))
    return costs.withColumns({"spent_before": spent, "admitted": (spent < ceiling) if ceiling > 0 else F.lit(True)})


def reserved(events: DataFrame, ceiling: float, key: str, order: list[str]) -> DataFrame:
    """Reservations with ``held_before``, ``spent_before`` and ``admitted``, of a log of several lanes.

    Events: (key, order, estimate_s, actual_s); a reservation has no actual, a
    settlement gives the estimate back and spends the actual. A reservation is
    admitted while what is spent and held stays below the ceiling (none or a
    negative one: always), and holds its estimate then; one that is refused
    holds nothing, and a later one finds room again when enough was given back.
    What is held never falls below nothing. As each decision depends on those
    before it, a run's rows stream through one task, sorted; none are kept.
    """
    rows = events.withColumns({"held_before": F.lit(0.0), "spent_before": F.lit(0.0), "admitted": F.lit(False)})
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, held, spent = object(), 0.0, 0.0
        for pdf in batches:
            before, kept = [], []
            amounts = (pdf[c].astype(float).fillna(0.0).clip(lower=0.0) for c in ("estimate_s", "actual_s"))
            for i, (own, estimate, actual, settles) in enumerate(zip(pdf[key], *amounts, pdf["actual_s"].notna(), strict=True)):
                if own != run and not (pd.isna(own) and run is None):
                    run, held, spent = None if pd.isna(own) else own, 0.0, 0.0
                if settles:
                    held, spent = max(held - estimate, 0.0), spent + actual
                    continue
                admitted = ceiling <= 0 or held + spent < ceiling
                kept.append(i)
                before.append((held, spent, admitted))
                held += estimate if admitted else 0.0
            out = pdf.iloc[kept].copy()
            out[["held_before", "spent_before", "admitted"]] = pd.DataFrame(before, columns=["h", "s", "a"], index=out.index)
            yield out.astype({"held_before": float, "spent_before": float, "admitted": bool})

    return dealt.mapInPandas(fold, rows.schema)


def retained(logs: DataFrame, name: str, keep: int = 20) -> DataFrame:
    """The newest logs by name; the rest may go."""
    return logs.orderBy(F.desc(name)).limit(max(keep, 1))
