"""Ordered rows of a key, without a task that holds all of a key.

A key's rows are numbered through ranges, dealt to chunks of numbers with some
neighbours at either side, and followed by doubled pointers. So a key with a
million rows is the work of many tasks, and a window only sees a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.scratch import dropped, kept

#: Rows of a chunk.
CHUNK = 4096


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    """``rows`` with their number from 0 in the order within each key, as a written table.

    Rows are sorted by ranges of key and order; a part's rows of a key follow
    those of the parts before it, whose counts are all that a window adds up.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    laid = kept(laid.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "numbered")
    parts = laid.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = laid.join(parts.withColumnRenamed(key, "_key"), (F.col(key).eqNullSafe(F.col("_key"))) & (laid["_part"] == parts["_part"]))
    return met.select(*rows.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))


def dealt(rows: DataFrame, before: int = 0, after: int = 0, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the ``chunk`` of their number, and again in those whose rows have them among the ``before`` last or ``after`` next ones.

    ``own`` tells the first from the others; at most one chunk's rows are neighbours.
    """
    if max(before, after) > chunk:
        raise ValueError("neighbours must fit in a chunk")
    at, place = F.floor(F.col(idx) / chunk), F.pmod(F.col(idx), F.lit(chunk))
    near = [at]
    if after:
        near.append(F.when((place < after) & (at > 0), at - 1))
    if before:
        near.append(F.when(place >= chunk - before, at + 1))
    return rows.withColumn("chunk", F.explode(F.array_compact(F.array(*near)))).withColumn("own", F.col("chunk") == at)


def followed(rows: DataFrame, at: str, other: DataFrame, key: str, idx: str = "idx", how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of the row of ``other`` (key, idx, ...) whose number is theirs in ``at``; null keys are equal."""
    right = other.withColumnsRenamed({key: "_key", idx: "_idx"})
    return rows.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_idx")), how).drop("_key", "_idx")


def orbits(starts: DataFrame, pointers: DataFrame, key: str, idx: str = "idx", to: str = "to") -> DataFrame:
    """(key, idx) of all rows that pointers (key, idx, to) lead to from the starts (key, idx), and of the starts.

    Pointers lead forward, and no two starts to one row. Each round doubles
    their reach, and those that lead out of the rows are gone, so the rounds
    are the logarithm of the longest way.
    """
    reached, jumps, held = kept(starts.select(key, idx), "reached"), kept(pointers.select(key, idx, to), "jumps"), []
    while not jumps.isEmpty():
        found = followed(reached, idx, jumps, key, idx).select(key, F.col(to).alias(idx))
        further = followed(jumps.withColumnRenamed(to, "_mid"), "_mid", jumps.select(key, idx, to), key, idx)
        held += [reached, jumps]
        reached, jumps = kept(reached.unionByName(found), "reached"), kept(further.select(key, idx, to), "jumps")
        dropped(*held)
        held = []
    dropped(jumps)
    return reached


def counted(rows: DataFrame, key: str, idx: str = "idx", name: str = "number", chunk: int = CHUNK) -> DataFrame:
    """``rows``, some of the numbered ones, with their number from 0 among these: by chunks of their old numbers."""
    at = rows.withColumn("_chunk", F.floor(F.col(idx) / chunk))
    sizes = at.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed(key, "_key").withColumnRenamed("_chunk", "_c")
    own = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(idx)) - 1
    met = at.withColumn("_own", own).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_c")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("int").alias(name))


def nearest(rows: DataFrame, key: str, marked: Column, most: int, idx: str = "idx", name: str = "head", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the number of the last marked one at or before each, which is at most ``most`` rows away."""
    near = Window.partitionBy(key, "chunk").orderBy(idx).rowsBetween(-most, 0)
    found = dealt(rows.withColumn("_mark", F.when(marked, F.col(idx))), before=most, idx=idx, chunk=chunk)
    return found.withColumn(name, F.last("_mark", ignorenulls=True).over(near)).where("own").select(*rows.columns, name)
