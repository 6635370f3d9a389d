"""Connected components of an edge table, by alternating large and small stars.

Each round joins every node with the smallest of its neighbours; the number of
rounds grows with the logarithm of the longest path. Minima are combined before
each shuffle, joins on a hot node are split by adaptive execution, and each
round's edges are a table in the shared folder, so a lost executor costs one
round at most; a round's table goes when the next one stands. No edge and no label goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuewright.llm.scratch import discard, stored


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (two columns of long); the root is the smallest node reachable.

    Self-loops and repeated edges do no harm; a null end drops the edge; no edges give no rows.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in edges.columns)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.isNull().alias("_n"), b.isNull().alias("_m"))
    now = stored(pairs.where("not _n and not _m and u <> v").select("u", "v").distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
