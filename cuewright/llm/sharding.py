"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; there is no
ring and no table. With one shard more, the expected 1/(n+1) of the rows move,
all of them into the new shard.

Defined cases: a null key is a key like another; repeated rows and ties of the
key go to one shard, each with a slot of its own; a null text has no bytes;
columns ``shard``, ``grown_shard``, ``slot`` and those that start with
``_shard_`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of a table that is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of one shard that are numbered together.
ROWS_A_BLOCK = 200_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to shards-1 of 64-bit keys: each key jumps ahead by its own pseudo-random steps until it leaves the range."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    nxt = np.zeros(len(state), np.int64)
    while len(live):
        at[live] = nxt[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any type."""

    @F.pandas_udf("int")
    def jump(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy(), shards))

    return jump(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, shards: int, rows_a_block: int = ROWS_A_BLOCK, spread: list[Column] | None = None) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 in each shard.

    Slots are numbered in blocks of about ``rows_a_block`` rows, cut by a hash
    of the key and of ``spread``, so that no task numbers a whole shard; blocks
    are offset by the counts of those before them.
    """
    df = df.drop("shard", "grown_shard", "slot", *[c for c in df.columns if c.startswith("_shard_")])
    df = df.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)})
    blocks = -(-df.count() // (shards * rows_a_block)) or 1
    cut = F.pmod(F.xxhash64(F.col(key), *(spread or []), F.lit("slot")), F.lit(blocks)).cast("int")
    rows = df.withColumn("_shard_block", cut)
    sizes = rows.groupBy("shard", "_shard_block").agg(F.count(F.lit(1)).alias("_shard_rows"))
    before = Window.partitionBy("shard").orderBy("_shard_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_shard_block", F.coalesce(F.sum("_shard_rows").over(before), F.lit(0)).alias("_shard_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_shard_block").orderBy(F.col(key), *(spread or [])))
    # one row for each block of a shard: rows / rows_a_block of them, or one a shard
    rows = rows.withColumn("_shard_place", place).join(F.broadcast(sizes) if blocks * shards <= BROADCAST_ROWS else sizes, ["shard", "_shard_block"])
    return rows.withColumn("slot", F.col("_shard_before") + F.col("_shard_place") - 1).drop("_shard_block", "_shard_before", "_shard_place")


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Rows written to one folder a shard."""
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards, by its doc_id alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", 40, spread=[F.col("text_crc32")])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
