"""Tracks against the speech of their films: one global answer, then windows.

A film's coarse signal meets a track's cues under every frame-rate hypothesis,
by transforms. Films of one block, as usual ones are, are done in one group:
the speech and some of the tracks, each measured as a whole and then in windows.
Longer ones are cut in blocks, which send their counts, some hundred kilobytes
a block, and what is counted adds up; windows of their fine signal are groups of
their own. No task holds a film's spans unless they fit one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.operators.signals import COARSE, FINE, LEAST_DENSITY, LEAST_SCORE, LOUD, QUIET, WINDOW_SEARCH, active_ends, active_within, block_size, frame_rates, marks, met_counts, overlaps, pearson, transform_size, transformed, vector
from cuewright.scratch import kept

# fixed values: failures of a measurement
NO_SPEECH, NO_CUES = "no speech was found in the audio track", "the track holds no dialogue to align"
FLAT_AUDIO, SPARSE = "the audio is almost all speech or almost all silence", "the track is too sparse to align"

BEST = "score double, offset_s double, scale double, failure string"
ANCHORS = "array<struct<at_s:double,offset_s:double,confidence:double>>"
#: Tracks of an item that are measured in one group.
LOT = 8


def _first(at: Column, width: float) -> Column:
    return F.floor(F.greatest(at, F.lit(0.0)) / width)


def _after(start: Column, end: Column, width: float) -> Column:
    """The bin after an interval's last."""
    return F.greatest(F.ceil(F.greatest(end, F.lit(0.0)) / width), _first(start, width) + 1)


def _tracks(speech: DataFrame, cues: DataFrame, item: str, track: str, runtime: str | None, most: float, size: int) -> DataFrame:
    """(_i, _t, duration, blocks, _no, _lot): each track, its number, and the group of its item's tracks that it is measured with."""
    last = F.max_by("end_s", F.struct("start_s", "end_s"))
    length = F.max(F.coalesce(F.col(runtime), F.lit(0.0))) if runtime else F.lit(0.0)
    heard = speech.groupBy(F.col(item).alias("_i")).agg(last.alias("_heard"), length.cast("double").alias("_runtime"))
    tracks = cues.groupBy(item, track).agg(last.alias("_said")).join(heard, F.col(item).eqNullSafe(F.col("_i")), "left")
    duration = F.greatest(F.coalesce("_runtime", F.lit(0.0)), F.coalesce("_heard", F.lit(0.0)), F.coalesce("_said", F.lit(0.0)) + most)
    tracks = tracks.select(F.col(item).alias("_i"), F.col(track).alias("_t"), duration.alias("duration"))
    place = F.row_number().over(Window.partitionBy("_i").orderBy("_t")) - 1
    blocks = F.greatest(F.ceil(F.ceil(F.col("duration") / COARSE) / size), F.lit(1))
    return tracks.withColumns({"blocks": blocks, "_no": F.monotonically_increasing_id(), "_lot": F.floor(place / LOT)})


def _spans(speech: DataFrame, cues: DataFrame, tracks: DataFrame, item: str, track: str) -> DataFrame:
    """(item, track, speech, start_s, end_s, duration): each track's cues and its film's speech."""
    tracks = tracks.select("_i", "_t", "duration")
    own = cues.select(item, track, F.lit(False).alias("speech"), "start_s", "end_s").join(tracks, F.col(item).eqNullSafe(F.col("_i")) & F.col(track).eqNullSafe(F.col("_t")))
    theirs = speech.select(F.col(item).alias("_s"), "start_s", "end_s").join(tracks, F.col("_s").eqNullSafe(F.col("_i")))
    columns = ["speech", "start_s", "end_s", "duration"]
    return own.select(item, track, *columns).unionByName(theirs.select(F.col("_i").alias(item), F.col("_t").alias(track), F.lit(True).alias("speech"), "start_s", "end_s", "duration"))


def _film(speech: np.ndarray, cues: np.ndarray, duration: float, scales: list[float], span: int) -> tuple:
    """(score, offset, scale, failure) of a film that fits one block, from the rows (start, end) of both sides."""
    bins, by = int(np.ceil(duration / COARSE)), np.array([1.0, *scales])
    sides = [(speech, by[:1]), (cues, by[1:])]
    ends, on = zip(*[(active_ends(x, k, COARSE, bins), marks(x, k, COARSE, bins)) for x, k in sides], strict=True)
    ends, audio, said = np.concatenate(ends), on[0][0], on[1]
    shown = (ends[1:, 0] >= 0) & (ends[0, 0] >= 0)
    active = np.where(shown, said.sum(axis=1), 0)
    sums = np.zeros((len(scales), 3, 2 * span + 1))
    measure = lambda: _best(scales, span, len(speech), len(cues), ends, int(audio.sum()), active, sums)
    if measure()[3] is not None:
        return measure()
    n = transform_size(bins, span)
    heard = transformed(audio, n)
    for s in np.flatnonzero(shown & (active > 0)):
        lag, first, last = overlaps(span, ends[0], ends[s + 1])
        own = np.zeros(bins + 2 * span)
        own[span : span + bins] = said[s]
        sums[s] = met_counts(own, heard, n, span), active_within(audio, 0, first - lag, last - lag), active_within(said[s], 0, first, last)
    return measure()


def _point(speech: np.ndarray, cues: np.ndarray, i: int, n: int, duration: float, offset: float, scale: float) -> tuple | None:
    """(at_s, offset_s, confidence) of window ``i`` of ``n``; the cues have the global answer taken out."""
    length, fine = duration / n, int(np.ceil(duration / FINE))
    low, high = int(np.floor(i * length / FINE)), min(int(np.ceil((i * length + length) / FINE)), fine)
    found = best_lag(vector(*speech.T, FINE, low, high), vector(*cues.T, FINE, low, high), FINE, WINDOW_SEARCH)
    strength = min(max((found[1] - 0.15) / 0.40, 0.0), 1.0) if found else 0.0
    centre = i * length + length / 2
    return (centre, offset + (scale - 1.0) * centre + scale * found[0], strength) if strength > 0 else None


def _short(speech: DataFrame, cues: DataFrame, tracks: DataFrame, item: str, track: str, scales: list[float], span: int, windows: int) -> DataFrame:
    """(item, track, score, offset_s, scale, failure, anchors) of tracks whose films fit one block: a group has the speech once and some tracks."""
    n = min(max(windows, 2), 64)
    own = cues.join(tracks, F.col(item).eqNullSafe(F.col("_i")) & F.col(track).eqNullSafe(F.col("_t")))
    lots = tracks.select("_i", "_lot").distinct()
    theirs = speech.select(F.col(item).alias("_s"), "start_s", "end_s").join(lots, F.col("_s").eqNullSafe(F.col("_i")))
    # speech has no track's number
    rows = own.select("_i", "_lot", "_no", "duration", "start_s", "end_s").unionByName(theirs.select("_i", "_lot", F.lit(-1).cast("long").alias("_no"), F.lit(0.0).alias("duration"), "start_s", "end_s"))

    def lot(g: pd.DataFrame) -> pd.DataFrame:
        no, times, lasts = g["_no"].to_numpy(), g[["start_s", "end_s"]].to_numpy(np.float64), g["duration"].to_numpy()
        heard, out = times[no < 0], []
        for k in np.unique(no[no >= 0]):
            said, duration = times[no == k], float(lasts[no == k][0])
            score, offset, scale, failure = _film(heard, said, duration, scales, span)
            points = [_point(heard, (said - offset) / scale, i, n, duration, offset, scale) for i in range(n)] if failure is None and score >= LEAST_SCORE else []
            out.append((k, score, offset, scale, failure, [dict(zip(("at_s", "offset_s", "confidence"), p, strict=True)) for p in points if p]))
        return pd.DataFrame(out, columns=["_no", "score", "offset_s", "scale", "failure", "anchors"])

    found = rows.groupBy("_i", "_lot").applyInPandas(lot, f"_no long, {BEST}, anchors {ANCHORS}")
    return tracks.select(F.col("_i").alias(item), F.col("_t").alias(track), "_no").join(found, "_no").drop("_no")


def _ends(spans: DataFrame, item: str, track: str, scales: list[float]) -> DataFrame:
    """(item, track, n_speech, n_cues, duration, ends): first and last active coarse bin of the speech, and of the cues under each scale; -1 for none."""
    count = F.ceil(F.col("duration") / COARSE)

    def both(scale: float, which: Column) -> list[Column]:
        start, end = F.col("start_s") / scale, F.col("end_s") / scale
        first = F.when(which & (_first(start, COARSE) < count), _first(start, COARSE))
        after = F.when(first.isNotNull(), F.least(_after(start, end, COARSE), count))
        return [F.coalesce(F.min(first), F.lit(-1)), F.coalesce(F.max(after) - 1, F.lit(-1))]

    ends = both(1.0, F.col("speech")) + [x for s in scales for x in both(s, ~F.col("speech"))]
    return spans.groupBy(item, track).agg(F.count_if("speech").alias("n_speech"), F.count_if(~F.col("speech")).alias("n_cues"), F.max("duration").alias("duration"), F.array(*ends).alias("ends"))


def _best(scales: list[float], span: int, n_speech: int, n_cues: int, ends: np.ndarray, audio_active: int, cue_active: np.ndarray, sums: np.ndarray) -> tuple:
    """(score, offset, scale, failure) from a whole film's counts; ``sums``: both, audio and cue counts by scale and lag."""
    nothing = (0.0, 0.0, 1.0)
    if not n_speech:
        return (*nothing, NO_SPEECH)
    if not n_cues:
        return (*nothing, NO_CUES)
    ends = ends.reshape(-1, 2)
    content = lambda active, e: active / (e[1] - e[0] + 1) if active else 0.0
    if not QUIET < content(audio_active, ends[0]) < LOUD:
        return (*nothing, FLAT_AUDIO)
    if content(cue_active[0], ends[1]) < LEAST_DENSITY:
        return (*nothing, SPARSE)
    best = nothing
    for k, scale in enumerate(scales):
        if not cue_active[k] or content(cue_active[k], ends[k + 1]) > LOUD:
            continue
        _, first, last = overlaps(span, ends[0], ends[k + 1])
        scores = pearson(last - first + 1, *sums[k])
        at = int(np.argmax(scores))
        if scores[at] > best[0]:
            best = (float(scores[at]), (at - span) * COARSE * scale, scale)
    return (*best, None)


def _global(spans: DataFrame, facts: DataFrame, item: str, track: str, scales: list[float], span: int, size: int) -> DataFrame:
    """(item, track, score, offset_s, scale, failure) over all blocks."""
    count = F.ceil(F.col("duration") / COARSE)
    blocks = F.greatest(F.ceil(count / size), F.lit(1))
    block = lambda x: F.floor(x / size)
    # a cue may lie in any block that a scale moves it to
    low = F.when(F.col("speech"), block(_first(F.col("start_s"), COARSE))).otherwise(block(_first(F.col("start_s") / max(scales), COARSE) - span))
    high = F.when(F.col("speech"), block(_after(F.col("start_s"), F.col("end_s"), COARSE) - 1)).otherwise(block(_after(F.col("start_s") / min(scales), F.col("end_s") / min(scales), COARSE) - 1 + span))
    dealt = spans.withColumns({"_a": F.greatest(low, F.lit(0)), "_b": F.least(high, blocks - 1)}).where("_b >= _a")
    no = F.lit(None)
    rows = dealt.select(item, track, F.explode(F.sequence("_a", "_b")).alias("block"), "speech", "start_s", "end_s", no.cast("array<bigint>").alias("facts"))
    told = F.concat(F.array("n_speech", "n_cues", count, blocks), F.col("ends"))
    rows = rows.unionByName(facts.select(item, track, F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"), no.cast("boolean").alias("speech"), no.cast("double").alias("start_s"), no.cast("double").alias("end_s"), told.alias("facts")))
    n, lags = transform_size(size, span), 2 * span + 1

    def one(g: pd.DataFrame) -> pd.DataFrame:
        told = g["facts"].notna()
        n_speech, n_cues, bins, n_blocks, *ends = (int(x) for x in g.loc[told, "facts"].iloc[0])
        ends, k = np.array(ends).reshape(-1, 2), int(g["block"].iloc[0])
        low, high = k * size, min((k + 1) * size, bins)
        rows = g[~told]
        sides = [rows.loc[rows["speech"] == side, ["start_s", "end_s"]].to_numpy(np.float64) for side in (True, False)]
        audio = vector(*sides[0].T, COARSE, low, high)
        heard = transformed(audio, n)
        sums, active = np.zeros((len(scales), 3, lags)), np.zeros(len(scales), np.int64)
        for s, scale in enumerate(scales):
            if ends[0, 0] < 0 or ends[s + 1, 0] < 0:
                continue
            said = vector(*(sides[1] / scale).T, COARSE, low - span, high + span)
            said[max(bins - (low - span), 0) :] = 0  # bins after the last are no cue's
            lag, first, last = overlaps(span, ends[0], ends[s + 1])
            own = said[span : span + high - low]
            active[s] = int(own.sum())
            sums[s] = met_counts(said, heard, n, span), active_within(audio, low, first - lag, last - lag), active_within(own, low, first, last)
        out = {item: [g[item].iloc[0]], track: [g[track].iloc[0]]}
        if n_blocks == 1:
            found = _best(scales, span, n_speech, n_cues, ends, int(audio.sum()), active, sums)
            return pd.DataFrame(out | {c: [v] for c, v in zip(("score", "offset_s", "scale", "failure"), found, strict=True)} | {"facts": [None], "active": [None], "sums": [None]})
        return pd.DataFrame(out | {"score": [None], "offset_s": [None], "scale": [None], "failure": [None], "facts": [[n_speech, n_cues, *ends.ravel().tolist()]], "active": [[int(audio.sum()), *active.tolist()]], "sums": [sums.astype(np.int32).tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        n_speech, n_cues, *ends = (int(x) for x in g["facts"].iloc[0])
        active = np.sum([np.asarray(x, np.int64) for x in g["active"]], axis=0)
        sums = np.sum([np.frombuffer(x, np.int32).astype(np.float64) for x in g["sums"]], axis=0).reshape(len(scales), 3, lags)
        found = _best(scales, span, n_speech, n_cues, np.array(ends), int(active[0]), active[1:], sums)
        return pd.DataFrame({item: [g[item].iloc[0]], track: [g[track].iloc[0]]} | {c: [v] for c, v in zip(("score", "offset_s", "scale", "failure"), found, strict=True)})

    kinds = dict(spans.dtypes)
    keys = f"`{item}` {kinds[item]}, `{track}` {kinds[track]}"
    counted = kept(rows.groupBy(item, track, "block").applyInPandas(one, f"{keys}, {BEST}, facts array<bigint>, active array<bigint>, sums binary"), "blocks")
    parts = counted.where("sums is not null").select(item, track, "facts", "active", "sums")
    return counted.where("sums is null").select(item, track, "score", "offset_s", "scale", "failure").unionByName(parts.groupBy(item, track).applyInPandas(add, f"{keys}, {BEST}"))


def _windows(spans: DataFrame, best: DataFrame, item: str, track: str, windows: int) -> DataFrame:
    """(item, track, anchors) of the matched tracks: each window of the fine signals, the global answer taken out of the cues."""
    n = min(max(windows, 2), 64)
    found = best.where((F.col("score") >= LEAST_SCORE) & F.col("failure").isNull()).select(F.col(item).alias("_i"), F.col(track).alias("_t"), "offset_s", "scale")
    met = spans.join(found, F.col(item).eqNullSafe(F.col("_i")) & F.col(track).eqNullSafe(F.col("_t")))
    at = lambda c: F.when(F.col("speech"), F.col(c)).otherwise((F.col(c) - F.col("offset_s")) / F.col("scale"))
    moved = met.select(item, track, "speech", at("start_s").alias("start_s"), at("end_s").alias("end_s"), "duration", "offset_s", "scale")
    length = F.col("duration") / n
    near = lambda x: F.floor(F.greatest(x, F.lit(0.0)) / length)
    dealt = moved.withColumns({"_a": F.greatest(near(F.col("start_s") - 2 * FINE), F.lit(0)), "_b": F.least(near(F.greatest("start_s", "end_s") + 2 * FINE), F.lit(n - 1))}).where("_b >= _a")
    rows = dealt.withColumn("window", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        i, duration, offset, scale = int(g["window"].iloc[0]), float(g["duration"].iloc[0]), float(g["offset_s"].iloc[0]), float(g["scale"].iloc[0])
        audio, cues = (g.loc[g["speech"] == side, ["start_s", "end_s"]].to_numpy(np.float64) for side in (True, False))
        rows = [p for p in [_point(audio, cues, i, n, duration, offset, scale)] if p]
        return pd.DataFrame([(g[item].iloc[0], g[track].iloc[0], *r) for r in rows], columns=[item, track, "at_s", "offset_s", "confidence"])

    kinds = dict(spans.dtypes)
    points = rows.groupBy(item, track, "window").applyInPandas(one, f"`{item}` {kinds[item]}, `{track}` {kinds[track]}, at_s double, offset_s double, confidence double")
    return points.groupBy(F.col(item).alias("_i"), F.col(track).alias("_t")).agg(F.array_sort(F.collect_list(F.struct("at_s", "offset_s", "confidence"))).alias("anchors"))


def best_lag(audio: np.ndarray, cues: np.ndarray, width: float, most: float) -> tuple[float, float] | None:
    """(lag in seconds, score) of the best lag of two signals of one length, or nothing if one has no shape or no score is positive."""
    span = round(max(most, 0) / width)
    ends = []
    for x in (audio, cues):
        on = np.flatnonzero(x)
        if not len(on) or len(on) / (on[-1] - on[0] + 1) > LOUD or span < 1:
            return None
        ends.append((int(on[0]), int(on[-1])))
    lag, first, last = overlaps(span, *ends)
    n = transform_size(len(audio), span)
    both = met_counts(np.concatenate([np.zeros(span), cues, np.zeros(span)]), transformed(audio, n), n, span)
    scores = pearson(last - first + 1, both, active_within(audio, 0, first - lag, last - lag), active_within(cues, 0, first, last))
    k = int(np.argmax(scores))
    return ((k - span) * width, float(scores[k])) if scores[k] > 0 else None


def aligned(speech: DataFrame, cues: DataFrame, item: str, track: str, runtime: str | None = None, windows: int = 12, most: float = 120.0, rates: bool = True, block: int | None = None) -> DataFrame:
    """(item, track, score, offset_s, scale, failure, anchors) of each track (item, track, start_s, end_s) against the speech of its item (item, start_s, end_s).

    Equal scores go to the scale nearest to 1 and then the lowest lag; a film
    without speech, one almost all or almost no speech, and a sparse track are
    failures; a track that matches nowhere has its score and no anchors.
    """
    scales = [1.0, *(p[3] for p in frame_rates())] if rates else [1.0]
    span = max(round(max(most, 0) / COARSE), 1)
    size = block or block_size(span)
    tracks = kept(_tracks(speech, cues, item, track, runtime, most, size), "tracks")
    short = _short(speech, cues, tracks.where("blocks = 1"), item, track, scales, span, windows)
    long = tracks.where("blocks > 1")
    if long.isEmpty():
        return short
    spans = kept(_spans(speech, cues, long, item, track), "spans")
    facts = _ends(spans, item, track, scales)
    best = kept(_global(spans, facts, item, track, scales, span, size), "measured")
    anchors = _windows(spans, best, item, track, windows)
    met = best.join(anchors, F.col(item).eqNullSafe(F.col("_i")) & F.col(track).eqNullSafe(F.col("_t")), "left")
    return short.unionByName(met.select(item, track, "score", "offset_s", "scale", "failure", F.coalesce("anchors", F.array().cast(ANCHORS)).alias("anchors")))
