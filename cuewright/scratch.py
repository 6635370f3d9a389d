"""Tables that an operator writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/cuewright-store"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(the file system of a path, a function from texts to its paths)."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, and its lineage cut."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing will read again."""
    for t in tables:
        fs, to = file_system(t.sparkSession, t.kept_at)
        fs.delete(to(t.kept_at), True)
