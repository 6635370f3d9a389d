"""Operators on measurements: offset votes, drift fits, verdicts, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.operators.signals import frame_rates

#: Seconds of a vote's bin, and between rivals. Most occurrences of a word that votes.
BIN, RIVAL, RARE = 0.2, 2.0, 6
#: Least confidence of a point; how near a scale must be to a known ratio; tolerated error; largest residual.
LEAST_CONFIDENCE, SNAP, TOLERANCE, RESIDUAL = 0.15, 0.0002, 0.35, 1.5
#: What a repair asks for: error, confidence, points.
REPAIR_ERROR, REPAIR_CONFIDENCE, REPAIR_POINTS = 0.6, 0.4, 2


def offset_histogram(cue_tokens: DataFrame, heard: DataFrame, key: str, most: float) -> DataFrame:
    """(key, bin, weight, votes) of the differences of equal words' times; words said often on either side have no vote.

    Frequent words are dropped by their counts before the join, so no word of a
    key meets more than six times six rows. Counts and join share one shuffle
    and one sort of each side.
    """

    def rare(tokens: DataFrame, name: str) -> DataFrame:
        rows = tokens.where(F.length("word") >= 2).select(key, "word", F.col("at_s").alias(name))
        return rows.withColumn(f"n_{name}", F.count(F.lit(1)).over(Window.partitionBy(key, "word"))).where(F.col(f"n_{name}") <= RARE)

    met = rare(cue_tokens, "c").join(rare(heard, "h"), [key, "word"]).withColumn("delta", F.col("c") - F.col("h"))
    met = met.where(F.abs("delta") <= most)
    return met.groupBy(key, F.round(F.col("delta") / BIN).cast("int").alias("bin")).agg(F.sum(1.0 / (F.col("n_c") * F.col("n_h"))).alias("weight"), F.count(F.lit(1)).alias("votes"))


def smoothed(histogram: DataFrame, key: str) -> DataFrame:
    """(key, bin, smooth): each bin and half of its neighbours."""
    spread = histogram.select(key, "weight", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in ((-1, 0.5), (0, 1.0), (1, 0.5))])).alias("m"), "bin")
    return spread.groupBy(key, (F.col("bin") + F.col("m.d")).alias("bin")).agg(F.sum(F.col("weight") * F.col("m.s")).alias("smooth"))


def measured_offset(histogram: DataFrame, key: str) -> DataFrame:
    """(key, offset_s, confidence, votes, runner_up_s); ties of the peak go to the smaller distance from zero, then the lower bin."""
    smooth = smoothed(histogram, key)
    # rounded: the order of a sum must not decide a tie
    order = [F.desc(F.round("smooth", 9)), F.abs("bin"), F.col("bin")]
    top = smooth.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").select(key, F.col("bin").alias("peak"), F.col("smooth").alias("height"))
    far = smooth.join(top, key).where(F.abs(F.col("bin") - F.col("peak")) * BIN >= RIVAL - 1e-9)
    rival = far.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").select(key, F.col("bin").alias("rival"), F.col("smooth").alias("rival_height"))
    near = F.when(F.abs(F.col("bin") - F.col("peak")) <= 1, F.col("weight")).otherwise(0.0)
    mass = histogram.join(top, key).groupBy(key, "peak", "height").agg(F.sum("weight").alias("total"), F.sum(near).alias("agree"), F.sum("votes").alias("votes"))
    done = mass.join(rival, key, "left")
    sure = F.col("agree") / F.col("total") * (1 - F.coalesce("rival_height", F.lit(0.0)) / F.col("height"))
    return done.select(key, (F.col("peak") * BIN).alias("offset_s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), "votes", (F.col("rival") * BIN).alias("runner_up_s"))


def identified_rate(scale: Column) -> Column:
    """struct(scale, label) of the first known ratio of frame rates within the tolerance, or null."""
    found = F.lit(None).cast("struct<scale:double,label:string>")
    for _, _, _, ratio, label in reversed(frame_rates()):
        found = F.when(F.abs(scale - ratio) <= SNAP, F.struct(F.lit(ratio).alias("scale"), F.lit(label).alias("label"))).otherwise(found)
    return found


def drift_fit(points: DataFrame, key: str, snap: bool = True) -> DataFrame:
    """(key, offset_s, scale, residual_s, points, frame_rate) of the weighted line through each key's (at_s, offset_s, confidence).

    Points below the least confidence don't count; a single one gives a flat
    line; a scale near a known ratio is moved there about the points' centre.
    """
    used = points.where(F.col("confidence") >= LEAST_CONFIDENCE).select(key, F.col("at_s").alias("x"), F.col("offset_s").alias("y"), F.col("confidence").alias("w"))
    centre = used.groupBy(key).agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"), F.count(F.lit(1)).alias("n"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    rows = used.join(centre, key)
    line = rows.groupBy(key, "sw", "mx", "my", "n").agg(F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dx * dy).alias("sxy"))
    line = line.withColumn("slope", F.when((F.col("sxx") > 1e-9) & (F.col("n") > 1), F.try_divide("sxy", "sxx")).otherwise(0.0))
    rate = identified_rate(1.0 + F.col("slope")) if snap else F.lit(None).cast("struct<scale:double,label:string>")
    line = line.withColumn("rate", F.when(F.col("n") > 1, rate)).withColumn("scale", F.coalesce("rate.scale", 1.0 + F.col("slope")))
    line = line.withColumn("b", F.col("my") - (F.col("scale") - 1.0) * F.col("mx"))
    error = F.col("y") - (F.col("b") + (F.col("scale") - 1.0) * F.col("x"))
    fitted = used.join(line, key).groupBy(key, "b", "scale", "sw", "n", "rate").agg(F.sum(F.col("w") * error * error).alias("r"))
    return fitted.select(key, F.col("b").alias("offset_s"), "scale", F.sqrt(F.col("r") / F.col("sw")).alias("residual_s"), F.col("n").alias("points"), F.col("rate.label").alias("frame_rate"))


def error_at(at: Column) -> Column:
    return F.col("offset_s") + (F.col("scale") - 1.0) * at


def assessed(points: DataFrame, fits: DataFrame, key: str, runtime: Column | float = 0.0, tolerance: float = TOLERANCE, residual: float = RESIDUAL) -> DataFrame:
    """The fit of each key of ``points`` with (anchors, confident, mean_confidence, verdict, worst_s, repairable)."""
    sure = F.col("confidence") >= LEAST_CONFIDENCE
    counted = points.groupBy(key).agg(F.count("at_s").alias("anchors"), F.count_if(sure).alias("confident"), F.avg(F.when(sure, F.col("confidence"))).alias("mean_confidence"), F.max("at_s").alias("last_s"))
    rows = counted.join(fits, key, "left").withColumns({"offset_s": F.coalesce("offset_s", F.lit(0.0)), "scale": F.coalesce("scale", F.lit(1.0)), "residual_s": F.coalesce("residual_s", F.lit(0.0))})
    until = F.lit(runtime) if not isinstance(runtime, Column) else runtime
    start, end = error_at(F.lit(0.0)), error_at(F.when(until > 0, until).otherwise(F.col("last_s")))
    flat, worst = F.abs("offset_s"), F.greatest(F.abs(start), F.abs(end))
    few = F.col("confident")
    verdict = (
        F.when(F.col("anchors") == 0, "Unknown")
        .when(few == 0, "Mismatched")
        .when((few == 1) & (flat <= tolerance), "InSync")
        .when(few == 1, "Offset")
        .when(few == 2, "Unknown")
        .when(F.col("residual_s") > residual, "Mismatched")
        .when(worst <= tolerance, "InSync")
        .when(F.abs(end - start) > tolerance, "Drifting")
        .otherwise("Offset")
    )
    shown = F.when((F.col("anchors") == 0) | (few == 0), 0.0).when((few <= 2) | (F.col("residual_s") > residual), flat).otherwise(worst)
    rows = rows.withColumns({"verdict": verdict, "worst_s": shown}).drop("last_s")
    return rows.withColumn("repairable", F.col("verdict").isin("Offset", "Drifting"))


def should_repair(enabled: bool = True, least_error: float = REPAIR_ERROR, least_confidence: float = REPAIR_CONFIDENCE) -> Column:
    """Whether an assessed row is to be rewritten."""
    return F.lit(enabled) & F.col("repairable") & (F.col("worst_s") >= least_error) & (F.col("confident") >= REPAIR_POINTS) & (F.coalesce("mean_confidence", F.lit(0.0)) >= least_confidence)


def lateness(seconds: Column) -> Column:
    """``1.4s late`` or ``1.4s early``."""
    return F.concat(F.format_string("%.1f", F.abs(seconds)), F.when(seconds >= 0, "s late").otherwise("s early"))


def verdict_text(verdict: Column, offset: Column) -> Column:
    """What is said of a track: in time, by how much it is off, or why nothing is known."""
    return (
        F.when(verdict == "InSync", "in sync")
        .when(verdict.isin("Offset", "Drifting"), F.concat(lateness(offset), F.when(verdict == "Drifting", ", drifting").otherwise("")))
        .when(verdict == "WrongLanguage", "the text is not the language the track claims")
        .when(verdict == "NoDialogue", "no dialogue to check")
        .otherwise("no conclusion")
    )
