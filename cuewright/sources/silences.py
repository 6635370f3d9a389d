"""Silence logs of an audio filter as spans of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _value(line: Column, name: str) -> Column:
    return F.regexp_extract(line, name + r"\s*([0-9.+-]*)", 1).try_cast("double")


def silences(logs: DataFrame, key: str = "item_id", content: str = "log", duration: str = "duration_s") -> DataFrame:
    """(key, duration, start_s, end_s) of each silence: from the first start after the last end, to the next end or the total.

    Where the duration is not known, the last time of the log stands for it.
    """
    lines = logs.select(key, duration, F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).alias("pos", "line"))
    start, end = _value(F.col("line"), "silence_start:"), _value(F.col("line"), "silence_end:")
    marks = lines.select(key, duration, "pos", start.alias("s"), F.when(start.isNull(), end).alias("e")).where("s is not null or e is not null")
    last = F.max(F.greatest("s", "e")).over(Window.partitionBy(key))
    marks = marks.withColumn(duration, F.when(F.col(duration) > 0, F.col(duration)).otherwise(last)).where(F.col(duration) > 0)
    # an episode ends with each end
    order = Window.partitionBy(key).orderBy("pos")
    episode = F.coalesce(F.sum(F.col("e").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.min_by(F.greatest("s", F.lit(0.0)), F.when(F.col("s").isNotNull(), F.col("pos")))
    found = marks.withColumn("k", episode).groupBy(key, duration, "k").agg(first.alias("start_s"), F.max("e").alias("e")).where("start_s is not null")
    closed = F.least(F.greatest("e", "start_s"), F.col(duration))
    return found.select(key, duration, F.when(F.col("e").isNull(), F.least("start_s", duration)).otherwise(F.col("start_s")).alias("start_s"), F.when(F.col("e").isNull(), F.col(duration)).otherwise(closed).alias("end_s"))


def speech(logs: DataFrame, key: str = "item_id", content: str = "log", duration: str = "duration_s") -> DataFrame:
    """(key, span_idx, start_s, end_s): what the silences leave of the duration; all of it without any.

    Where the duration is not known, that of the log stands for it; with neither there is no span.
    """
    quiet = silences(logs, key, content, duration)
    known = logs.where(F.col(duration) > 0).select(key, duration).unionByName(quiet.select(key, duration)).distinct()
    walls = quiet.unionByName(known.select(key, duration, F.col(duration).alias("start_s"), F.col(duration).alias("end_s")))
    before = Window.partitionBy(key).orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    gaps = walls.withColumn("from_s", F.coalesce(F.max("end_s").over(before), F.lit(0.0))).where("start_s > from_s")
    number = F.row_number().over(Window.partitionBy(key).orderBy("from_s")) - 1
    return gaps.select(key, number.alias("span_idx"), F.col("from_s").alias("start_s"), F.col("start_s").alias("end_s"))
