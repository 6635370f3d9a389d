"""A store of reports: one row an item, saved by upsert into buckets of items.

A bucket has two slots. A save reads the newer slot of the buckets that it has
rows for, and writes the merged rows into the other one, by overwriting that
partition alone; the higher ``saved`` number is the newer. So a reader that has
listed the store keeps reading the slot that no save is writing, a save that
fails changes nothing, and there are at most two files a bucket. One job saves
at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuewright.operators.reports import latest
from cuewright.scratch import file_system

#: Buckets of a store; a bucket is one task's work, so a large store has more.
BUCKETS = 64
_OWN = ("bucket", "slot", "saved")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, to = file_system(spark, path)
    return fs.exists(to(path))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _slots(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """All rows of the store, and (bucket, slot, saved) of the newest slot of each bucket. Files that are no Parquet are skipped."""
    rows = spark.read.schema(f"{schema}, saved long, bucket int, slot int").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    newest = rows.groupBy("bucket").agg(F.max(F.struct("saved", "slot")).alias("n"))
    return rows, newest.select("bucket", "n.slot", "n.saved")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def save_reports(reports: DataFrame, path: str, key: str = "item_id", checked: str = "checked_at", tie: str | None = None, buckets: int = BUCKETS) -> None:
    """Put reports (item_id, checked_at, ...) in the place of older ones of their items.

    Only buckets with new rows are read and written. What is broadcast is a row
    a bucket.
    """
    spark, order = reports.sparkSession, [c for c in (checked, tie) if c]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields)
    new = reports.withColumn("bucket", _bucket(key, buckets))
    if _exists(spark, path):
        rows, newest = _slots(spark, path, schema)
        touched = newest.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")
        # newer slots of touched buckets: partitions that the join leaves out are not read
        old = rows.join(F.broadcast(touched.select("bucket", "slot")), ["bucket", "slot"], "left_semi").select(*reports.columns, "bucket")
        new = new.unionByName(old)
    else:
        newest = _empty(spark, "bucket int, slot int, saved long")
    merged = latest(new, key, *order)
    placed = merged.join(F.broadcast(newest), "bucket", "left").withColumns({"slot": 1 - F.coalesce("slot", F.lit(1)), "saved": F.coalesce("saved", F.lit(0)) + 1})
    dealt = placed.select(*reports.columns, "saved", "bucket", "slot").repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(path)


def stored_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The report of each item; a store that is not there has none."""
    if not _exists(spark, path):
        return _empty(spark, schema)
    rows, newest = _slots(spark, path, schema)
    return rows.join(F.broadcast(newest.select("bucket", "slot")), ["bucket", "slot"], "left_semi").drop(*_OWN)


def clear_reports(spark: SparkSession, path: str, schema: str) -> int:
    """Remove the store; how many items it had reports of."""
    n = stored_reports(spark, path, schema).count()
    fs, to = file_system(spark, path)
    fs.delete(to(path), True)
    return n
