"""Operators on binned activity: intervals become sparse rows (key, bin), two such signals are aligned by correlation.

An interval marks the bins from floor(start / width) up to ceil(end / width), at
least one. The correlation at a lag is Pearson's r of two 0/1 vectors over the
bins where both have content; one side shifted by ``lag`` lies on the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.operators.intervals import overlapping
from cuewright.scratch import kept

# fixed values: frames a second that transfers use
RATES = (23.976, 24.0, 25.0, 29.97, 30.0)
#: Seconds: coarse and fine bin, search of a window. Least global score and cue density. Bounds of audio coverage.
COARSE, FINE, WINDOW_SEARCH = 0.2, 0.02, 4.0
LEAST_SCORE, LEAST_DENSITY, QUIET, LOUD = 0.25, 0.05, 0.02, 0.95
#: Fewest bins of an overlap; bins beside a peak, and fewest others, for its prominence.
LEAST_OVERLAP, GUARD, BACKGROUND = 16, 3, 8


def frame_rates() -> list[tuple[int, float, float, float, str]]:
    """(rank, from, to, scale, label) of each ordered pair of rates, nearest to 1 first; ties in the order of the rates."""
    pairs = [(a, b) for a in RATES for b in RATES if a != b]
    pairs.sort(key=lambda p: abs(p[1] / p[0] - 1.0))
    return [(k, a, b, b / a, f"{a:g} → {b:g} fps") for k, (a, b) in enumerate(pairs)]


def marked(spans: DataFrame, keys: list[str], width: float, duration: Column | None = None, shift: Column | float = 0.0, scale: Column | float = 1.0) -> DataFrame:
    """(keys, bin): the distinct bins that the spans (start_s, end_s) mark, after t -> (t + shift) / scale, below ``duration``."""
    at = lambda c: (F.col(c) + shift) / scale
    first = F.floor(F.greatest(at("start_s"), F.lit(0.0)) / width)
    last = F.greatest(F.ceil(F.greatest(at("end_s"), F.lit(0.0)) / width), first + 1)
    if duration is not None:
        last = F.least(last, F.ceil(duration / width))
    rows = spans.withColumns({"_a": first, "_b": last - 1}).where("_b >= _a")
    return rows.select(*keys, F.explode(F.sequence("_a", "_b")).alias("bin")).distinct()


def coverage(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, active, first_active, last_active, content_coverage) of each signal."""
    found = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("active"), F.min("bin").alias("first_active"), F.max("bin").alias("last_active"))
    return found.withColumn("content_coverage", F.col("active") / (F.col("last_active") - F.col("first_active") + 1))


def correlation_curve(audio: DataFrame, cues: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, lag, score) for every lag from -span to span, in DataFrame operations; ``runs_curve`` of the bins' runs."""
    return runs_curve(runs(audio, keys), runs(cues, keys), keys, span)


def runs(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): first and last bin of the runs of distinct bins (keys, bin)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("bin"))
    return bins.withColumn("_run", F.col("bin") - place).groupBy(*keys, "_run").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).drop("_run")


def marked_runs(spans: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``runs`` of the bins that the spans (start_s, end_s) mark, without a row a bin."""
    first = F.floor(F.greatest("start_s", F.lit(0.0)) / width)
    rows = spans.select(*keys, first.alias("a"), (F.greatest(F.ceil(F.greatest("end_s", F.lit(0.0)) / width), first + 1) - 1).alias("b"))
    order = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_begins", (before.isNull() | (F.col("a") > before + 1)).cast("int"))
    found = begins.withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(*keys, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def runs_curve(audio: DataFrame, cues: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, lag, score) for every lag from -span to span of two signals given as ``runs``, in DataFrame operations.

    What two runs share at a lag rises by one a lag, stays, and falls: so a pair
    of runs near each other is four corners, added up by lag, and what is shared
    at a lag is the sum over the corners up to it. A pair of bins is never a row.
    """
    audio, cues = kept(audio, "runs"), kept(cues, "runs")
    a = audio.groupBy(*keys).agg(F.min("a").alias("fa"), F.max("b").alias("la"))
    ends = a.join(cues.groupBy(*keys).agg(F.min("a").alias("fc"), F.max("b").alias("lc")), keys)
    met = overlapping(audio, cues.withColumnsRenamed({"a": "c", "b": "e"}), keys, ("a", "b"), ("c", "e"), 2 * span + 1, span)
    low, here, there = F.col("c") - F.col("b"), F.col("b") - F.col("a") + 1, F.col("e") - F.col("c") + 1
    corner = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    corners = met.select(*keys, F.explode(F.array(corner(low, 1), corner(low + here, -1), corner(low + there, -1), corner(low + here + there, 1))).alias("x")).select(*keys, "x.at", "x.d").where(F.col("at") <= span)
    turns = corners.groupBy(*keys, F.greatest("at", F.lit(-span)).alias("lag")).agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("at")).alias("da"))
    lags = ends.withColumn("lag", F.explode(F.sequence(F.lit(-span), F.lit(span)).cast("array<bigint>")))
    lags = lags.withColumns({"lo": F.greatest("fc", F.col("fa") + F.col("lag")), "hi": F.least("lc", F.col("la") + F.col("lag"))})

    def ranges(on: DataFrame, at: Column, upto: Column, name: str) -> DataFrame:
        """Of each lag, the active bins in [at, upto]: those up to its end less those before it, from where runs begin and end."""
        no = F.lit(None).cast("bigint").alias("lag")
        events = on.select(*keys, F.col("a").alias("t"), F.lit(1).alias("d"), no, F.lit(0).alias("end")).unionByName(on.select(*keys, (F.col("b") + 1).alias("t"), F.lit(-1).alias("d"), no, F.lit(0).alias("end")))
        begin = lags.select(*keys, (at - 1).alias("t"), F.lit(0).alias("d"), "lag", F.lit(-1).alias("end"))
        stop = lags.select(*keys, upto.alias("t"), F.lit(0).alias("d"), "lag", F.lit(1).alias("end"))
        upto_t = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
        count = (F.col("t") + 1) * F.sum("d").over(upto_t) - F.sum(F.col("d") * F.col("t")).over(upto_t)
        every = events.unionByName(begin).unionByName(stop).withColumn("n", count).where("lag is not null")
        return every.groupBy(*keys, "lag").agg(F.sum(F.col("n") * F.col("end")).alias(name))

    lags = lags.join(ranges(cues, F.col("lo"), F.col("hi"), "sc"), [*keys, "lag"]).join(ranges(audio, F.col("lo") - F.col("lag"), F.col("hi") - F.col("lag"), "sa"), [*keys, "lag"])
    passed = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    added = lambda c: F.coalesce(F.sum(c).over(passed), F.lit(0))
    lags = lags.join(turns, [*keys, "lag"], "left").withColumns({"both": (F.col("lag") + 1) * added("d") - added("da"), "n": F.col("hi") - F.col("lo") + 1})
    return lags.select(*keys, "lag", _pearson().alias("score"))


def _pearson() -> Column:
    """r of 0/1 vectors of ``n`` bins, by the bins active in either (``sa``, ``sc``) and in ``both``."""
    n, sa, sc, b = (F.col(x).cast("double") for x in ("n", "sa", "sc", "both"))
    flat = (n < LEAST_OVERLAP) | (sa <= 0) | (sc <= 0) | (sa >= n) | (sc >= n)
    return F.when(flat, 0.0).otherwise((n * b - sa * sc) / (F.sqrt(n * sa - sa * sa) * F.sqrt(n * sc - sc * sc)))


def peaks(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, score, prominence) of the highest score of each curve, the lowest lag of ties; none without a positive one."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "lag")
    best = curve.withColumn("_r", F.row_number().over(order)).where("_r = 1 and score > 0").select(*keys, F.col("lag").alias("peak"), F.col("score").alias("top"))
    far = curve.join(best, keys).groupBy(*keys, "peak", "top").agg(*[f(F.when(F.abs(F.col("lag") - F.col("peak")) > GUARD, F.col("score"))).alias(n) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))])
    shown = F.when((F.col("n") >= BACKGROUND) & (F.col("var") > 1e-12), (F.col("top") - F.col("mean")) / F.sqrt("var")).otherwise(0.0)
    return far.select(*keys, F.col("peak").alias("lag"), F.col("top").alias("score"), shown.alias("prominence"))


def confidence(prominence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (prominence - 3) / 9))


def match_strength(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 0.15) / 0.40))


# the kernels: a block of a signal, inside a task


def vector(start: np.ndarray, end: np.ndarray, width: float, low: int, high: int) -> np.ndarray:
    """0/1 vector of the bins from ``low`` to below ``high`` that intervals mark, by adding up where they begin and end."""
    first = np.floor(np.maximum(start, 0) / width).astype(np.int64)
    last = np.maximum(np.ceil(np.maximum(end, 0) / width).astype(np.int64), first + 1)
    keep = (first < high) & (last > low)
    edge = np.zeros(high - low + 1, np.int64)
    np.add.at(edge, np.maximum(first[keep], low) - low, 1)
    np.add.at(edge, np.minimum(last[keep], high) - low, -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.float64)


def _scaled(spans: np.ndarray, scales: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, after): bins of the rows (start, end) under each scale; a time that is no number is zero."""
    first = np.floor(np.fmax(spans[:, 0] / scales[:, None], 0) / width).astype(np.int64)
    return first, np.maximum(np.ceil(np.fmax(spans[:, 1] / scales[:, None], 0) / width).astype(np.int64), first + 1)


def active_ends(spans: np.ndarray, scales: np.ndarray, width: float, bins: int) -> np.ndarray:
    """First and last active bin below ``bins`` under each scale; -1 for none."""
    first, after = _scaled(spans, scales, width)
    inside = first < bins
    low = np.min(np.where(inside, first, bins), axis=1, initial=bins)
    high = np.max(np.where(inside, np.minimum(after, bins), 0), axis=1, initial=0) - 1
    return np.stack([np.where(low < bins, low, -1), high], 1)


def marks(spans: np.ndarray, scales: np.ndarray, width: float, bins: int) -> np.ndarray:
    """0/1 vectors of the bins from 0 to below ``bins`` that intervals mark under each scale."""
    first, after = _scaled(spans, scales, width)
    inside, row = first < bins, np.arange(len(scales))[:, None] * (bins + 1)
    edge = np.bincount((row + first)[inside], minlength=len(scales) * (bins + 1)) - np.bincount((row + np.minimum(after, bins))[inside], minlength=len(scales) * (bins + 1))
    return (np.cumsum(edge.reshape(len(scales), bins + 1)[:, :-1], axis=1) > 0).astype(np.float64)


def transformed(audio: np.ndarray, size: int) -> np.ndarray:
    return np.conj(np.fft.rfft(audio, size))


def transform_size(block: int, span: int) -> int:
    """The least 2^k, 3 * 2^k or 5 * 2^k in which a block meets its cues without wrapping around."""
    least = block + 2 * span
    return min(by << max(-(-least // by) - 1, 0).bit_length() for by in (1, 3, 5))


def met_counts(cues: np.ndarray, heard: np.ndarray, size: int, span: int) -> np.ndarray:
    """Bins active in both at each lag from -span to span, by one transform.

    ``heard`` is of a block's audio; the cues begin ``span`` bins before the
    block and end as many after it, so that the first lags are whole (overlap-save).
    """
    return np.rint(np.fft.irfft(np.fft.rfft(cues, size) * heard, size)[: 2 * span + 1])


def overlaps(span: int, audio_ends: tuple[int, int], cue_ends: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first, last): the cue's bins at each lag where both signals have content."""
    lags = np.arange(-span, span + 1)
    return lags, np.maximum(cue_ends[0], audio_ends[0] + lags), np.minimum(cue_ends[1], audio_ends[1] + lags)


def active_within(on: np.ndarray, low: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of a vector that begins at bin ``low``, the active bins from ``first`` to ``last``."""
    upto = np.concatenate([[0], np.cumsum(on)])
    at = lambda x: upto[np.clip(x - low, 0, len(on))]
    return np.maximum(at(last + 1) - at(first), 0)


def pearson(n: np.ndarray, both: np.ndarray, sa: np.ndarray, sc: np.ndarray) -> np.ndarray:
    """r at each lag, 0 for short overlaps and flat sides."""
    n = n.astype(np.float64)
    ok = (n >= LEAST_OVERLAP) & (sa > 0) & (sc > 0) & (sa < n) & (sc < n)
    below = np.sqrt(np.where(ok, n * sa - sa * sa, 1)) * np.sqrt(np.where(ok, n * sc - sc * sc, 1))
    return np.where(ok, (n * both - sa * sc) / below, 0.0)


def block_size(span: int) -> int:
    """Bins of a block: most of a transform is then no overlap."""
    return max(1 << 16, 1 << int(8 * span - 1).bit_length())


def summed_curve(audio: DataFrame, cues: DataFrame, keys: list[str], span: int, block: int | None = None) -> DataFrame:
    """(keys, lag, score) for every lag from -span to span, by transforms of blocks of a signal.

    Every block of the audio meets the cues that are within the span of it. What
    a block counts at a lag adds up over blocks, so a long recording is many
    tasks' work, and none holds a key's bins.
    """
    size = block or block_size(span)
    a, c = coverage(audio, keys), coverage(cues, keys)
    ends = a.select(*keys, F.col("first_active").alias("fa"), F.col("last_active").alias("la")).join(c.select(*keys, F.col("first_active").alias("fc"), F.col("last_active").alias("lc")), keys)
    at = lambda x: F.floor(x / size)
    none = [F.lit(None).cast("bigint").alias(x) for x in ("fa", "la", "fc", "lc")]
    left = audio.select(*keys, at(F.col("bin")).alias("block"), F.lit(0).alias("side"), "bin", *none)
    right = cues.select(*keys, F.explode(F.sequence(at(F.col("bin") - span), at(F.col("bin") + span))).alias("block"), F.lit(1).alias("side"), "bin", *none)
    spread = F.explode(F.sequence(at(F.least("fa", "fc")), at(F.greatest("la", "lc")))).alias("block")
    told = ends.select(*keys, spread, F.lit(2).alias("side"), F.lit(None).cast("bigint").alias("bin"), "fa", "la", "fc", "lc")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        facts, low = g[g["side"] == 2], int(g["block"].iloc[0]) * size
        if not len(facts):
            return pd.DataFrame({k: [] for k in [*keys, "lag", "both", "sa", "sc"]}, dtype=object)
        fa, la, fc, lc = (int(facts[x].iloc[0]) for x in ("fa", "la", "fc", "lc"))
        heard, said = np.zeros(size), np.zeros(size + 2 * span)
        on = lambda side: g.loc[g["side"] == side, "bin"].to_numpy().astype(np.int64) - low
        heard[on(0)] = said[on(1) + span] = 1
        n = transform_size(size, span)
        lags, first, last = overlaps(span, (fa, la), (fc, lc))
        both = met_counts(said, transformed(heard, n), n, span) if heard.any() and said.any() else np.zeros(len(lags))
        out = {"lag": lags, "both": both, "sa": active_within(heard, low, first - lags, last - lags), "sc": active_within(said[span : span + size], low, first, last)}
        return pd.DataFrame({k: [g[k].iloc[0]] * len(lags) for k in keys} | out)

    kinds = dict(audio.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lag long, both double, sa double, sc double"
    counts = left.unionByName(right).unionByName(told).groupBy(*keys, "block").applyInPandas(one, schema)
    sums = counts.groupBy(*keys, "lag").agg(*[F.sum(x).alias(x) for x in ("both", "sa", "sc")]).join(ends, keys)
    first, last = F.greatest("fc", F.col("fa") + F.col("lag")), F.least("lc", F.col("la") + F.col("lag"))
    return sums.withColumn("n", last - first + 1).select(*keys, "lag", _pearson().alias("score"))
