"""Streams of subtitle files, and of what is seen of them: only what is new or has changed goes on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuewright.functions.language import script
from cuewright.functions.text import clean_line
from cuewright.sources.srt import parsed

#: Types of keys that their texts stand for.
_EXACT = ("tinyint", "smallint", "int", "bigint", "decimal", "boolean", "date", "string")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, content, seen_at) of whole files under ``path``, as a stream."""
    rows = spark.readStream.format("text").option("wholetext", True).load(path)
    return rows.select(F.col("_metadata.file_path").alias("track_id"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("seen_at"))


def write_cleaned(stream: DataFrame, table_path: str, checkpoint: str):
    """Append the cleaned cues of each new file to a Parquet table; parsing needs whole files, so it is done by micro-batch."""

    def batch(files: DataFrame, number: int) -> None:
        cues = parsed(files).withColumns({"clean": clean_line(F.col("text")), "batch": F.lit(number)}).where("clean <> ''")
        cues.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(stream: DataFrame, delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Files and scripts seen in each window, with late ones up to the delay."""
    return stream.withWatermark("seen_at", delay).groupBy(F.window("seen_at", window)).agg(F.count(F.lit(1)).alias("files"), F.count(script(F.col("content"))).alias("scripted"))


def changed(seen: DataFrame, key: str = "item_id", delay: str = "1 hour", forget_s: int = 90 * 86_400, groups: int = 1024) -> DataFrame:
    """(key, version, seen_at, change) of a stream of sightings (key, version, seen_at): the items that are to be checked.

    The state store holds the last version of each item, so an item goes on
    when it is ``new``, or ``changed`` from a version that was known; a sighting
    older than the last one counts for nothing, and of one batch the last
    counts. An item that nobody has seen for ``forget_s`` seconds of the
    stream's own time is ``gone``, and new if it comes back. A stream that
    starts again from its checkpoint repeats nothing.

    Items share their state by hash, in ``groups`` groups, as a call for each
    item costs far more than its rows; the number is a checkpoint's for good.
    Within a call an item is known by its text, so the key is to be of a type
    that a text stands for exactly.
    """
    kind = dict(seen.dtypes)[key]
    if kind.split("(")[0] not in _EXACT:
        raise TypeError(f"{key} is {kind}; items are known by one of {', '.join(_EXACT)}")
    item = F.col(f"`{key}`").cast("string")
    rows = seen.where("seen_at is not null").withWatermark("seen_at", delay)
    rows = rows.select(F.pmod(F.xxhash64(item), F.lit(groups)).alias("part"), item.alias("item"), F.coalesce("version", F.lit("")).alias("version"), F.unix_micros("seen_at").alias("at"), "seen_at")

    def some(part: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {item: known for item, *known in zip(*state.get, strict=True)} if state.exists else {}
        last, out = {}, []
        for pdf in () if state.hasTimedOut else batches:
            for item, version, at in zip(pdf["item"], pdf["version"], pdf["at"].tolist(), strict=True):
                if item not in last or (at, version) > last[item]:
                    last[item] = (at, version)
        for item, (at, version) in last.items():
            known, before, _ = held.get(item, (None, None, None))
            if before is not None and at < before:
                at, version = before, known
            elif before is None:
                out.append((item, version, at, "new"))
            elif known != "" and known != version:
                out.append((item, version, at, "changed"))
            held[item] = (version, at, max(at // 1000 + forget_s * 1000, now + 1))
        for item in [item for item, (_, _, until) in held.items() if until < now]:
            version, at, _ = held.pop(item)
            out.append((item, version, at, "gone"))
        if held:
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(min(until for _, _, until in held.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["item", "version", "at", "change"])

    found = rows.groupBy("part").applyInPandasWithState(some, "item string, version string, at long, change string", "items array<string>, versions array<string>, ats array<long>, untils array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("item").cast(kind).alias(key), "version", F.timestamp_micros("at").alias("seen_at"), "change")


def write_changed(stream: DataFrame, table_path: str, checkpoint: str, key: str = "item_id", **options):
    """Append what ``changed`` finds to a Parquet table; a batch that runs again after a failure writes its rows once."""
    found = changed(stream, key, **options)
    return found.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
