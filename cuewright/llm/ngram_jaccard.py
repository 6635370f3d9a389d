"""N-gram Jaccard join: components of documents whose n-gram sets are alike.

The document by n-gram incidence matrix is multiplied with its transpose, but
only where a product can reach the bound. In order:

1. Texts become rows (sets of hashed word n-grams); equal rows are one row.
2. Each row is entered under its prefix: the columns, rare ones first, of which
   two linked rows must share one. N-grams that a stated share of all documents
   has come last in that order, so passages that many documents share form no
   large columns.
3. Columns are cut by size class, as rows of very different sizes cannot be
   linked, and of columns with the same rows one is kept. Rows that meet in a
   column are compared by size and by a parity sketch, both of which bound the
   overlap from above; what remains is a forest of possible links for each
   column, never all its pairs.
4. Components of these forests are blocks of rows. Overlap counts accumulate in
   the product of each block, pairs below the bound of their sizes are
   discarded, and the links left give the components. A block of many rows is
   cut, and each two of its parts are multiplied in a task of their own.

No step samples or caps: no link is lost, and none is assumed. Words, n-grams
and whole sets are known by hashes of 64 bits, without a second look: among n
of them some two share one with odds of about n^2 / 2^65, which is 1 in 40 for
10^9 and near certain beyond 10^10, and such a pair then counts as equal.

Defined cases: a null or empty text, or one of white space, has an empty set
and is linked with nothing, not even with another such text; texts of fewer
words than the n-gram's width are one n-gram; repeated rows are linked like
other equal texts; an empty table gives an empty result; null keys are no keys:
such rows are left out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuewright.llm.components import connected_components
from cuewright.llm.incidence import fingerprint, linked, parity_sketch, possible_edges, prefix
from cuewright.llm.kernels import batch_word_hashes, released, shingles, word_hashes
from cuewright.llm.scratch import discard, shuffle_partitions, stored

#: An n-gram that one of so many documents has is common and comes last in the order of columns.
COMMON = 1000
#: Most of them that are broadcast, at 8 bytes each.
MOST_COMMON = 2_000_000
#: Rows of blocks that are broadcast to the texts; of more, texts are shuffled.
BROADCAST_MEMBERS = 1_000_000
#: Size classes are as wide as so many steps of the least similarity.
CLASSES = 3
#: Rows of a column, and rows or elements of a block, that one task takes; more are cut in parts.
COLUMN_ROWS, BLOCK_ROWS, BLOCK_ELEMENTS = 8192, 1024, 2_000_000


def _rows(batch: pa.RecordBatch, at: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index in the batch, ascending set) of each text."""
    for first, h, off in batch_word_hashes(batch.column(at)):
        off = off.tolist()
        for k in range(len(off) - 1):
            yield first + k, shingles(h[off[k] : off[k + 1]], width)


def _frequent(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """N-grams that are frequent within some thousands of documents, with their counts there."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= max(4, len(held) / COMMON)
        return pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["gram", "n"])

    for batch in batches:
        held, size = [], 0
        for _, s in _rows(batch, 0, width):
            held.append(s)
            size += len(s)
            if size > 3_000_000:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)


def common_grams(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """The n-grams of at least one in ``COMMON`` documents, sorted; of more than ``MOST_COMMON`` the more frequent ones.

    They decide the order of columns alone, so that a count that misses rare
    occurrences, or a shorter list, changes the speed and never a result.
    """
    found = docs.select(text).mapInArrow(lambda b: released(_frequent(b, width)), "gram long, n long")
    table = stored(found.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    bounds = [max(8, docs.count() // COMMON) << k for k in range(24)]
    sizes = table.agg(*[F.count_if(F.col("n") >= x) for x in bounds]).first()
    least = next((x for x, size in zip(bounds, sizes, strict=True) if size <= MOST_COMMON), None)
    grams = table.where(F.lit(False) if least is None else F.col("n") >= least).select("gram").toArrow()["gram"]
    discard(table)
    return np.sort(grams.to_numpy().astype(np.int64).view(np.uint64))


def _entered(batches: Iterable[pa.RecordBatch], width: int, percent: int, hot) -> Iterator[pa.RecordBatch]:
    """Per document: key, size, set id, prefix and sketch; the last two only where the task first meets the set."""
    seen: set[int] = set()
    names = ["key", "n", "sid", "prefix", "sketch"]
    for batch in batches:
        own, held, size = batch.column(0).to_pylist(), [], 0
        for k, s in _rows(batch, 1, width):
            sid = fingerprint(s) if len(s) else None
            fresh = sid is not None and sid not in seen
            if fresh:
                seen.add(sid)
                if len(seen) > 200_000:
                    seen.clear()
            held.append((own[k], len(s), sid, prefix(s, hot.value, percent).view(np.int64) if fresh else None, parity_sketch(s, percent).tobytes() if fresh else None))
            size += len(s)
            if size > 1_000_000:
                yield _batch(held, names)
                held, size = [], 0
        if held:
            yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Consecutive rows of equal ``by``, of sorted batches, whole, as arrays by column."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for pdf in batches:
        if not len(pdf):
            continue
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        codes = [columns[c] for c in by]
        changed = np.zeros(len(pdf) - 1, bool)
        for c in codes:
            changed |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), len(pdf)]
        if held and any(held[-1][c][-1] != columns[c][0] for c in by):
            yield whole()
            held = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            held.append({c: x[a:b] for c, x in columns.items()})
            if b < len(pdf):
                yield whole()
                held = []
    if held:
        yield whole()


def _once(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of one set id once."""
    _, first = np.unique(g["sid"], return_index=True)
    return g if len(first) == len(g["sid"]) else {c: x[first] for c, x in g.items()}


def _column_edges(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    known: set[tuple[int, int]] = set()
    out: list[tuple[int, int]] = []
    for g in _groups(batches, ["gram", "i", "j"]):
        if len(g["sid"]) == 2:
            pair = tuple(g["sid"].tolist())
            if pair[0] == pair[1] or pair in known:
                continue
            known.add(pair)
            if len(known) > 100_000:
                known.clear()
        g = _once(g)
        i, j = int(g["i"][0]), int(g["j"][0])
        left = None
        if i != j:  # two parts of a column: compared across
            order = np.argsort(g["part"], kind="stable")
            g, left = {c: x[order] for c, x in g.items()}, int((g["part"] == i).sum())
        out += possible_edges(g["sid"], g["n"], [np.frombuffer(x, np.uint64) for x in g["sketch"]], percent, left)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["a", "b"])


def _in_parts(rows: DataFrame, parts: str) -> DataFrame:
    """Each row once for each two parts (i <= j) of its group that it is in; ``part`` is its own."""
    own = F.pmod(F.xxhash64("sid"), F.col(parts)).cast("int")
    rows = rows.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", parts)


def _block_links(batches: Iterator[pd.DataFrame], width: int, percent: int) -> Iterator[pd.DataFrame]:
    """Of each block: a star of every component to its smallest set id, and how many documents each row is linked with."""
    for g in _groups(batches, ["root", "i", "j"]):
        i, j = int(g["i"][0]), int(g["j"][0])
        sets = [shingles(word_hashes(t), width) for t in g["text"]]
        # a key that repeats with another text has another set
        own = np.array([len(s) > 0 and fingerprint(s) == k for s, k in zip(sets, g["sid"], strict=True)])
        g = _once({c: x[own] for c, x in g.items() if c != "text"} | {"at": np.flatnonzero(own)})
        if len(g["sid"]) < 2:
            continue
        found = linked([sets[k] for k in g["at"]], percent)
        if i != j:
            part = g["part"]
            found &= part[:, None] != part[None, :]
        sid, copies = g["sid"], g["copies"]
        links = found @ copies
        least = sid.copy()
        todo = np.flatnonzero(links)
        while len(todo):  # the smallest id spreads along links
            spread = np.array([min(least[k], least[found[k]].min()) for k in todo])
            if (spread == least[todo]).all():
                break
            least[todo] = spread
        if len(todo):
            yield pd.DataFrame({"sid": sid[todo], "least": least[todo], "links": links[todo]})


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every document.

    ``component_id`` is the smallest key reachable by links, itself included;
    ``n_links`` counts the other documents that a document is linked with.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    hot = spark.sparkContext.broadcast(common_grams(rows, "text", width))
    entered = stored(rows.mapInArrow(lambda b: released(_entered(b, width, percent, hot)), "key long, n long, sid long, prefix array<long>, sketch binary"), "rows")

    # columns that at least two rows have, by size class; of columns of the same rows one
    entries = entered.where("prefix is not null").select("sid", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("gram"))
    # a set that several tasks have met is told from others, and counted, where a column's entries meet: they are shuffled once
    again = F.lag("sid").over(Window.partitionBy("gram").orderBy("sid"))
    once = entries.withColumn("before", again).where("before is null or before <> sid")
    shared = once.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("m > 1")
    ratio = (100 / percent) ** CLASSES if percent < 100 else 2.0
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio)) + 1e-9)
    also = F.floor(F.log(F.col("n") * 100.0 / percent) / float(np.log(ratio)) + 1e-6)
    met = shared.select("sid", "gram", F.explode(F.array_distinct(F.array(size_class, also))).alias("class"))
    met = stored(met.select("sid", F.xxhash64("gram", "class").alias("gram")), "columns")
    rows_of = met.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("m > 1")
    parts = rows_of.groupBy("m", "x", "y").agg(F.min("gram").alias("gram")).select("gram", F.ceil(F.col("m") / COLUMN_ROWS).alias("parts"))
    sketches = entered.where("sketch is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    columns = _in_parts(met.join(parts, "gram").join(sketches, "sid"), "parts").repartition(n, "gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    edges = columns.mapInPandas(lambda b: released(_column_edges(b, percent)), "a long, b long")
    blocks = connected_components(edges).withColumnRenamed("node", "sid")

    # one document of each row of a block has its text read again
    firsts = entered.where("sid is not null").groupBy("sid").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    members = stored(blocks.join(firsts, "sid"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_ELEMENTS)).alias("parts"))
    chosen = members.join(sizes, "root").select("sid", "root", "copies", "parts", F.col("first").alias("key"))
    few = members.count() <= BROADCAST_MEMBERS  # 40 bytes a row: the texts then need not be shuffled
    texts = rows.join(F.broadcast(chosen) if few else chosen, "key")
    texts = _in_parts(texts.select("text", "sid", "root", "copies", "parts"), "parts").repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "sid")
    links = stored(texts.mapInPandas(lambda b: released(_block_links(b, width, percent)), "sid long, least long, links long"), "links")

    discard(met, members)
    labels = connected_components(links.select("sid", "least")).withColumnRenamed("node", "sid")
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"))
    known = firsts.join(labels, "sid", "left").join(counts, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "root").select("sid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = entered.select("key", "n", "sid").join(known, "sid", "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under three-word shingles and a similarity of 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, width=3, percent=90)
