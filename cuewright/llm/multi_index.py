"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by a codebook of their own, so that a few
centroids make a fine grid of cells. A query ranks the centroids of each half
and visits pairs of them in the order of the sum of their distances, taken from
a heap, until the cells visited hold a stated share of the index; their entries
are reranked by the exact distance on the original vectors.

Every row is indexed; the codebooks are fitted on a bounded sample. Cells are
packed into blocks of a stated number of entries, and a cell of more entries is
cut by a hash, so no task holds a hot cell whole. An entry is shuffled once, to
its block; a query goes to the blocks it visits, with the sum up to which it
visits cells, and a block's queries stream past its entries.

Defined cases: vectors that are null, zero or hold a null or non-finite
component take no part, nor do those of another length than the most frequent
one (ties: the longer); a query's own id is no candidate; equal distances go to
the smaller id; with fewer candidates all are returned; an empty table gives an
empty result; repeated ids are candidates like others, and as queries one, of
the least of their vectors; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cuewright.llm.scratch import shuffle_partitions

#: Rows that the codebooks are fitted on, centroids of a half, and entries of a block.
SAMPLE, CENTROIDS, BLOCK = 8192, 64, 32768


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = squared(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def visited(near: np.ndarray, far: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[list[int], float]:
    """Cells that hold entries, in the order of their summed distances, by a heap, until they hold ``wanted`` entries; and the last sum."""
    first, second = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    a, b = near[first].tolist(), far[second].tolist()
    heap, cells, have, width, total = [(a[0] + b[0], 0, 0)], [], 0, len(b), 0.0
    reached = [0] * len(a)  # of each row of the grid, how far it has been taken
    while heap and have < wanted:
        total, i, j = heapq.heappop(heap)
        cell = int(first[i]) * width + int(second[j])
        reached[i] = j + 1
        if counts[cell]:
            cells.append(cell)
            have += int(counts[cell])
        # a pair enters when both its predecessors have been taken
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return cells, total


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) with vec as doubles, of the vectors that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec").isNotNull() & ~F.exists("vec", bad)).where(F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (size["d"] if size else 0))


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, share: float = 0.5, sample: int = SAMPLE, centroids: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest entries found for every row that ``is_query`` (a condition on ``id``) holds for.

    ``share`` is the part of the index that a query visits. Vectors without
    clusters, as here, need a large one for a recall of 0.9; clustered ones
    need some hundredths.
    """
    rows = valid_vectors(df, key, vector)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()["vec"].to_pylist()
    if not fitted:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = np.array(fitted, np.float64)
    half = (points.shape[1] + 1) // 2
    books = kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids) if points.shape[1] > half else np.zeros((1, 0))
    width = len(books[1])

    def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(vectors[:, :half], books[0]), squared(vectors[:, half:], books[1])

    def cells_of(vectors: np.ndarray) -> np.ndarray:
        near, far = halves(vectors)
        return near.argmin(1) * width + far.argmin(1)

    @F.pandas_udf("int")
    def cell(vec: pd.Series) -> pd.Series:
        return pd.Series(cells_of(np.stack(vec.to_numpy())) if len(vec) else [], dtype="int32")

    index = rows.withColumn("cell", cell("vec"))
    counts = np.zeros(len(books[0]) * width, np.int64)
    for c, n in index.groupBy("cell").count().collect():  # at most centroids squared rows
        counts[c] = n
    total = int(counts.sum())
    wanted = max(int(np.ceil(share * total)), 20 * k)
    # cells to blocks, in order; a cell of more than a block is cut
    first, parts, at, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if filled and filled + n > block:
            at, filled = at + 1, 0
        first[c], parts[c] = at, max(1, -(-n // block))
        if parts[c] > 1:
            at, filled = at + int(parts[c]), 0
        else:
            filled += n

    spread, cuts = [df.sparkSession.sparkContext.broadcast(x) for x in (first, parts)]

    @F.pandas_udf("int")
    def block_of(cells: pd.Series, hashes: pd.Series) -> pd.Series:
        c = cells.to_numpy()
        return pd.Series(spread.value[c] + hashes.to_numpy() % cuts.value[c], dtype="int32")

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, width_of = spread.value, cuts.value
        for pdf in batches:
            if not len(pdf):
                continue
            near, far = halves(np.stack(pdf["vec"].to_numpy()))
            for q, vec, a, b in zip(pdf["id"], pdf["vec"], near, far, strict=True):
                cells, reach = visited(a, b, counts, wanted)
                blocks = np.unique(np.concatenate([begin[c] + np.arange(width_of[c]) for c in cells]))
                yield pd.DataFrame({"block": blocks.astype(np.int32), "asks": True, "id": q, "vec": [vec] * len(blocks), "cell": -1, "reach": reach})

    schema = "block int, asks boolean, id long, vec array<double>, cell int, reach double"
    queries = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec")).mapInPandas(traverse, schema)
    entries = index.select(block_of("cell", F.xxhash64("id")).alias("block"), F.lit(False).alias("asks"), "id", "vec", "cell", F.lit(0.0).alias("reach"))
    both = entries.unionByName(queries).repartition(shuffle_partitions(df.sparkSession), "block").sortWithinPartitions("block", "asks")

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, own = None, [], None
        for pdf in batches:
            for (block, asks), g in pdf.groupby(["block", "asks"]):
                vecs, ids = np.stack(g["vec"].to_numpy()), g["id"].to_numpy()
                if not asks:
                    held, here, own = [*(held if here == block else []), (ids, vecs, g["cell"].to_numpy())], block, None
                    continue
                if here != block:
                    continue
                own = own or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                cells, at = np.unique(own[2], return_inverse=True)
                near, far = halves(vecs)
                found = []
                for q, vec, sums, reach in zip(ids, vecs, near[:, cells // width] + far[:, cells % width], g["reach"], strict=True):
                    # the sums are taken again here: their last digits may differ
                    k_at = np.flatnonzero((sums <= reach + 1e-9 * (1 + abs(reach)))[at] & (own[0] != q))
                    if not len(k_at):
                        continue
                    d = own[1][k_at] - vec
                    score = np.sqrt(np.einsum("ij,ij->i", d, d))
                    if len(k_at) > 4 * k:  # ties of the k-th stay
                        keep = score <= np.partition(score, k - 1)[k - 1]
                        k_at, score = k_at[keep], score[keep]
                    best = np.lexsort((own[0][k_at], score))[:k]
                    found.append((np.full(len(best), q), own[0][k_at[best]], score[best]))
                if found:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    found = both.mapInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for every hundredth of them."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
