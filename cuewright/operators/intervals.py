"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuewright.scratch import kept

#: Rows of one side of a bucket that one task takes; more are cut in parts.
MOST = 100_000


def _spread(rows: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    """Each row once for each bucket that it touches, with the first of them."""
    first, last = F.floor(start / width), F.floor(F.greatest(start, end) / width)
    return rows.withColumn(f"_first_{name}", first).withColumn("_bucket", F.explode(F.sequence(f"_first_{name}", last)))


def overlapping(left: DataFrame, right: DataFrame, key: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float, slack: float = 0.0, most: int = MOST) -> DataFrame:
    """Rows of both sides, of one key, whose spans overlap or are at most ``slack`` apart; touching counts.

    Spans meet by buckets of ``width``, which should be about the length of the
    usual one: a span is copied for each bucket it touches, and a pair is made
    in the first bucket that both touch. Where a bucket has more than ``most``
    rows of the left side, these are cut in parts and the right side's rows are
    copied to each, so no task has it whole. An end before its start is the
    start; a null start, end or key meets nothing. Other columns must have names
    of their own.
    """
    clash = set(left.columns) & set(right.columns) - set(key)
    if clash:
        raise ValueError(f"both sides have a column {', '.join(sorted(clash))}")
    a, b = (F.col(c) for c in left_span)
    c, d = (F.col(c) for c in right_span)
    known = a.isNotNull() & b.isNotNull()
    asked = c.isNotNull() & d.isNotNull()
    one = _spread(left.where(known), a - slack, F.greatest(a, b) + slack, width, "l")
    other = _spread(right.where(asked), c, d, width, "r")
    full = kept(one.groupBy(*key, "_bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).where("_parts > 1"), "full-buckets")
    on = [*key, "_bucket"]
    if not full.isEmpty():
        parts = lambda rows: rows.join(full, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        one = parts(one).withColumn("_part", F.pmod(F.xxhash64(*[F.col(x) for x in left.columns]), F.col("_parts")).cast("int")).drop("_parts")
        other = parts(other).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        on = [*on, "_part"]
    met = one.join(other, on).where(F.col("_bucket") == F.greatest("_first_l", "_first_r"))
    met = met.where((F.greatest(b, a) + slack >= c) & (a - slack <= F.greatest(c, d)))
    return met.select(*key, *[x for x in left.columns if x not in key], *[x for x in right.columns if x not in key])
