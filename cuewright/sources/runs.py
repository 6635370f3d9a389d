"""A log of runs: events are appended to a partition a run, and a run's state is what they add up to.

An event is a row (run_id, at, kind, ...) of ``EVENTS``: ``begin`` with what
started the run and how many items it means to visit, ``item`` for each one done,
``end`` with how it ended. A run that began and did not end is running, or was
abandoned if nobody works on it. The newest runs by name are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.operators.library import KEPT_RUNS, recent_runs
from cuewright.operators.reports import time_left
from cuewright.scratch import file_system

EVENTS = "run_id string, at timestamp, kind string, cause string, planned int, item_id string, clips int, audio_s double, cost decimal(18,6), elapsed_ms long, status string, error string"
#: How a run may end.
ENDINGS = ("Completed", "Cancelled", "Failed")


def append(events: DataFrame, path: str) -> None:
    """Add events; columns of ``EVENTS`` that they lack are null."""
    kinds = events.sparkSession.createDataFrame([], EVENTS).schema
    own = [F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields]
    events.select(*own).write.mode("append").partitionBy("run_id").parquet(path)


def _event(spark: SparkSession, run_id: str, at, **more) -> DataFrame:
    schema = spark.createDataFrame([], EVENTS).schema
    return spark.createDataFrame([tuple(({"run_id": run_id, "at": at} | more).get(f.name) for f in schema.fields)], schema)


def begin(spark: SparkSession, path: str, run_id: str, at, cause: str, planned: int) -> None:
    append(_event(spark, run_id, at, kind="begin", cause=cause, planned=planned), path)


def finished(items: DataFrame, path: str) -> None:
    """Items that runs are done with: (run_id, at, item_id, clips, audio_s, cost, elapsed_ms, error)."""
    append(items.withColumn("kind", F.lit("item")), path)


def end(spark: SparkSession, path: str, run_id: str, at, status: str, error: str | None = None, keep: int = KEPT_RUNS) -> list[str]:
    """The run's last event; then older runs than the newest ``keep`` go, whose names it returns."""
    if status not in ENDINGS:
        raise ValueError(f"a run ends as one of {', '.join(ENDINGS)}")
    append(_event(spark, run_id, at, kind="end", status=status, error=error), path)
    return rotate(spark, path, keep)


def rotate(spark: SparkSession, path: str, keep: int = KEPT_RUNS) -> list[str]:
    """Drop the partitions of all but the newest runs by name; their names."""
    fs, to = file_system(spark, path)
    folders = {s.getPath().getName(): s.getPath() for s in fs.listStatus(to(path)) if s.isDirectory() and s.getPath().getName().startswith("run_id=")}
    gone = sorted(folders, reverse=True)[max(keep, 1) :]
    for name in gone:
        fs.delete(folders[name], True)
    return [name.removeprefix("run_id=") for name in gone]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, started_at, finished_at, status, cause, planned, items, failed, minutes, cost, error): events of each run added up.

    ``cost`` is null where no item had a price. The sums are combined before
    they are shuffled, so a run of many items is no task's.
    """
    events = spark.read.schema(EVENTS).parquet(path)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return events.groupBy("run_id").agg(
        F.coalesce(F.min(of("begin", "at")), F.min("at")).alias("started_at"),
        F.max(of("end", "at")).alias("finished_at"),
        F.coalesce(F.max_by(of("end", "status"), of("end", "at")), F.lit("Running")).alias("status"),
        F.max(of("begin", "cause")).alias("cause"),
        F.max(of("begin", "planned")).alias("planned"),
        F.count_if(F.col("kind") == "item").alias("items"),
        F.count(of("item", "error")).alias("failed"),
        (F.coalesce(F.sum(of("item", "audio_s")), F.lit(0.0)) / 60).alias("minutes"),
        F.sum(of("item", "cost")).alias("cost"),
        F.max_by(of("end", "error"), of("end", "at")).alias("error"),
    )


def recent(spark: SparkSession, path: str, live: DataFrame, limit: int = KEPT_RUNS) -> DataFrame:
    """The last runs, newest first; one that did not end and isn't among the ``live`` ones (run_id) was abandoned."""
    return recent_runs(runs(spark, path), live, limit)


def progress(spark: SparkSession, path: str, now) -> DataFrame:
    """(run_id, seconds_left) of runs that have not ended, at the rate of their last items."""
    open_ = runs(spark, path).where("status = 'Running'").select("run_id", (F.col("planned") - F.col("items")).alias("todo"))
    done = spark.read.schema(EVENTS).parquet(path).where("kind = 'item'").select("run_id", F.unix_micros("at").alias("us")).join(open_, "run_id")
    return time_left(done.withColumn("at_s", F.col("us") / 1e6), F.col("todo"), F.lit(now.timestamp()), "run_id")
