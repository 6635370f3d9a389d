"""What files there are, by listing alone: paths, sizes and times; none is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuewright.functions.commands import media_version
from cuewright.operators.reports import needs_check

#: Ticks of 100 ns from the year 1 to 1970.
_EPOCH_TICKS = 621_355_968_000_000_000


def ticks(at: Column) -> Column:
    """100 ns steps since the year 1."""
    return F.unix_micros(at) * 10 + F.lit(_EPOCH_TICKS)


def listed_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, folder, bytes, modified, version) of every file under a folder whose name has the pattern.

    The source's columns of metadata are all that is asked for, so Spark lists
    folders, many at once beyond some, and reads no content.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    rows = rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "bytes", "modified", media_version(F.col("bytes"), ticks(F.col("modified"))).alias("version"))


def due(spark: SparkSession, items: DataFrame, root: str, stored: DataFrame, pattern: str = "*", key: str = "item_id", path: str = "path") -> DataFrame:
    """Items (item_id, path) whose file is new or has changed since the stored version, with that of the file; a file that isn't there has an empty one."""
    files = listed_files(spark, root, pattern).select(F.col("path").alias("_path"), "version")
    now = items.join(files, F.col(path) == F.col("_path"), "left").drop("_path").withColumn("version", F.coalesce("version", F.lit("")))
    return needs_check(now, stored, key)


def beside(files: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, path, media): files in the folder of an item's media (item_id, media), for ``operators.library.inventory``."""
    folder = F.regexp_extract("media", r"^(.*)/[^/]*$", 1)
    return items.select("item_id", "media", folder.alias("folder")).join(files.select("path", "folder"), "folder").where("path <> media").select("item_id", "path", "media")
