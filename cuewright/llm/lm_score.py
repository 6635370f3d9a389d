"""Language-model scoring by cross-entropy difference.

Two models of one form, smoothing and vocabulary are counted: one on a target,
one on the background of all documents. The difference of their losses on a
token says how much more it looks like the target; the mean over its tokens
scores a document (lower: more like the target).

The shared vocabulary is every word that occurs at least ``LEAST`` times; all
others are the unknown word. Words of at least a stated rate (at most 1/``RATE``
of them, whatever the corpus) form bigrams; a bigram of at least ``LEAST``
occurrences has a probability of its own, mixed with that of its second word.
What a document alone has says nothing of the corpus it is in, hence that bound.

1. One pass counts the words of all documents, and finds bigrams that are
   frequent within a block of texts.
2. One pass posts the documents' bigrams and rarer words, packed by buckets of
   their keys, so that all of a key meet in one task; of frequent bigrams only
   counts are posted. Each bucket counts its keys and answers each document with
   the change of its losses. Buckets grow in number with the corpus.
3. One pass adds up what words and frequent bigrams give, and joins the answers.

No table of bigrams is kept: they are counted and used where they meet.

Defined cases: a null or empty text has no tokens, null losses and a null
score; without any target document, the target model is uniform; repeated rows
count as often as they occur; a null target or background is none; columns of
the names of ``ADDED``, and those that start with ``_lm_``, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuewright.llm.kernels import NO_WORD, batch_word_hashes, mix64
from cuewright.llm.scratch import discard, shuffle_partitions, stored

#: Ids of target documents that are broadcast; with more, the texts are joined by one shuffle and stored.
BROADCAST_IDS = 2_000_000
#: Least share of all words of a word that forms bigrams, and of a bigram whose loss is broadcast: 1/rate of them at most.
RATE, HOT = 2e-7, 1e-5
#: Fewest occurrences of a word or bigram that the models tell apart.
LEAST = 2
#: Words that a task works on at once, and words of the corpus for one bucket.
BLOCK, PART = 1_000_000, 3_000_000
#: Weight of the bigram where it can be told, and of additive smoothing.
MIX, ADD = 0.6, 0.1
#: What is counted: in the target, in the background.
SIDES = ("target", "background")
_RARE = np.uint64(1 << 63)
ADDED = ["n_words", "target_loss", "background_loss", "score"]


@dataclass(frozen=True)
class Models:
    """Counts of the words that form bigrams, what the others have in common, and the frequent bigrams."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray  # (2, words)
    n_words: int  # in the vocabulary
    sums: np.ndarray  # of all words, by model
    unknown: np.ndarray  # occurrences of the unknown word, by model
    hot: np.ndarray  # sorted hashes of the frequent bigrams
    hot_words: np.ndarray  # (2, hot): numbers of their words

    def alone(self, side: int, count: np.ndarray) -> np.ndarray:
        """Probability of words of these counts by themselves."""
        return (count + ADD) / (self.sums[side] + ADD * (self.n_words + 1))

    def told(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words that form bigrams; -1 for the others."""
        return _place(self.words, h)

    def bigram_change(self, side: int, first: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """By how much the loss of a word changes where its bigram has this count instead of none."""
        before, p = self.counts[side][first], self.alone(side, self.counts[side][word])
        return np.where(before > 0, -np.log1p(MIX * count / (np.maximum(before, 1) * (1 - MIX) * p)), 0.0)

    def rare_change(self, side: int, count: np.ndarray) -> np.ndarray:
        return np.log(self.alone(side, self.unknown[side])) - np.log(self.alone(side, count))


def _place(listed: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
    return np.where(listed[at] == h, at, -1)


def pair_keys(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash for a bigram of hashed words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Block:
    """Texts of a batch from ``begin`` on: the hashes of their words, and which text each is of."""

    begin: int
    size: int
    h: np.ndarray
    doc: np.ndarray

    def pairs(self) -> np.ndarray:
        """Where a word follows another one of its text."""
        return np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1


def _blocks(texts: pa.Array, block: int) -> Iterator[Block]:
    held, size = [], 0

    def joined() -> Block:
        counts = np.concatenate([np.diff(off) for _, _, off in held])
        return Block(held[0][0], len(counts), np.concatenate([h for _, h, _ in held]), np.repeat(np.arange(len(counts)), counts))

    for part in batch_word_hashes(texts, NO_WORD):
        held.append(part)
        size += len(part[1])
        if size > block:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def _both(inverse: np.ndarray, target: np.ndarray, background: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(inverse, x, n).astype(np.int64) for x in (target, background)]


def _counted(batches: Iterable[pa.RecordBatch], hot: float, block: int) -> Iterator[pa.RecordBatch]:
    """Of batches (text, target, background): counts of all words (``first`` is null), and of the bigrams that are frequent in a block."""
    for batch in batches:
        flags = [_flags(batch.column(i)) for i in (1, 2)]
        for b in _blocks(batch.column(0), block):
            of = [x[b.begin : b.begin + b.size][b.doc] for x in flags]
            keys, inverse = np.unique(b.h, return_inverse=True)
            counts = _both(inverse, *of, len(keys))
            at = b.pairs()
            _, place, inverse = np.unique(pair_keys(b.h[at - 1], b.h[at]), return_index=True, return_inverse=True)
            both = _both(inverse, *[x[at] for x in of], len(place))
            often = np.flatnonzero(both[1] >= max(4, hot * len(b.h)))
            at = at[place[often]]
            first = pa.array(np.concatenate([keys, b.h[at - 1]]).view(np.int64), mask=np.arange(len(keys) + len(at)) < len(keys))
            arrays = [np.concatenate([keys, b.h[at]]).view(np.int64), *[np.concatenate([x, y[often]]) for x, y in zip(counts, both, strict=True)]]
            yield pa.RecordBatch.from_arrays([first, *(pa.array(x) for x in arrays)], names=["first", "word", *SIDES])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one compressed string: byte by byte of their places, as the high ones are mostly alike."""
    parts = []
    for x in arrays:
        parts += [np.array([len(x), x.dtype.itemsize], "<u4").tobytes(), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes, *dtypes: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for dtype in dtypes:
        n, width = np.frombuffer(raw, "<u4", 2, at).tolist()
        out.append(np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n).T.copy().view(dtype).reshape(n))
        at += 8 + n * width
    return out


_POSTED = (np.int64, np.uint8, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)


def _posted(batches: Iterable[pa.RecordBatch], shared, buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Of batches (id, text, target, background): what each bucket gets of a block, packed."""
    models: Models = shared.value
    number = TaskContext.get().partitionId() << 32  # a block's name: no two blocks share one, whatever their texts
    for batch in batches:
        every = batch.column(0).to_numpy()
        flags = [_flags(batch.column(i)) for i in (2, 3)]
        for b in _blocks(batch.column(1), block):
            ids, marks = every[b.begin : b.begin + b.size], [x[b.begin : b.begin + b.size] for x in flags]
            name, number = number, number + 1
            w, at = models.told(b.h), b.pairs()
            at = at[(w[at] >= 0) & (w[at - 1] >= 0)]
            hot = _place(models.hot, pair_keys(b.h[at - 1], b.h[at])) if len(models.hot) else np.full(len(at), -1)
            often, inverse = np.unique(hot[hot >= 0], return_inverse=True)
            counts = _both(inverse, *[x[b.doc[at[hot >= 0]]] for x in marks], len(often))
            at, rare = at[hot < 0], np.flatnonzero(w < 0)
            keys = np.concatenate([(w[at - 1].astype(np.uint64) << np.uint64(32)) | w[at].astype(np.uint64), b.h[rare] | _RARE])
            doc = b.doc[np.concatenate([at, rare])]
            order = np.argsort(keys, kind="stable")  # texts stay in order within a key
            keys, doc = keys[order], doc[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            lead = np.flatnonzero(new)
            times = np.diff([*lead, len(keys)]) if len(lead) else lead
            keys, doc = keys[lead], doc[lead]
            own = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            keys, doc, times, own = keys[order], doc[order], times[order], own[order]
            hot_own = (mix64(often.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            numbers, data = np.union1d(own, hot_own), []
            cuts, ends = np.searchsorted(own, numbers), np.searchsorted(own, numbers, side="right")
            by_bucket = np.argsort(hot_own, kind="stable")
            hot_cuts, hot_ends = np.searchsorted(hot_own[by_bucket], numbers), np.searchsorted(hot_own[by_bucket], numbers, side="right")
            for s, e, hs, he in zip(cuts.tolist(), ends.tolist(), hot_cuts.tolist(), hot_ends.tolist(), strict=True):
                docs, place = np.unique(doc[s:e], return_inverse=True)
                k, h = keys[s:e], by_bucket[hs:he]
                data.append(_packed(
                    ids[docs], (marks[0][docs] + 2 * marks[1][docs]).astype(np.uint8),
                    np.diff(k, prepend=np.uint64(0)), place.astype(np.uint32), times[s:e].astype(np.uint32),
                    often[h].astype(np.uint32), counts[0][h].astype(np.uint32), counts[1][h].astype(np.uint32),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.full(len(numbers), name)), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


#: Of a block: its texts' ids and the changes of their losses, packed; or the counts of a frequent bigram.
ANSWER = "block long, data binary, hot int, target double, background double"


def _answers(blocks=(), data=(), hot=(), target=(), background=()) -> pa.Table:
    n, k = len(data), len(hot)
    fill = lambda x, kind, before, after: pa.concat_arrays([pa.nulls(before, kind), pa.array(x, kind), pa.nulls(after, kind)])
    arrays = [fill(blocks, pa.int64(), 0, k), fill(data, pa.binary(), 0, k), fill(hot, pa.int32(), n, 0), fill(target, pa.float64(), n, 0), fill(background, pa.float64(), n, 0)]
    return pa.table(arrays, names=["block", "data", "hot", *SIDES])


def _answered(table: pa.Table, shared) -> pa.Table:
    """Of one bucket: the changes of the losses of each block's texts, and the counts of frequent bigrams."""
    models: Models = shared.value
    posted, blocks = [_unpacked(x.as_py(), *_POSTED) for x in table.column("data")], table.column("block").to_numpy()
    hot, inverse = np.unique(np.concatenate([p[5] for p in posted]), return_inverse=True)
    totals = [np.bincount(inverse, np.concatenate([p[i] for p in posted]), len(hot)) for i in (6, 7)]
    keys = np.concatenate([np.cumsum(p[2]) for p in posted])
    if not len(keys):
        return _answers(hot=hot.astype(np.int32), target=totals[0], background=totals[1])
    # each text of each block has a place of its own here
    base = np.cumsum([0, *(len(p[0]) for p in posted)])
    every, flags = np.concatenate([p[0] for p in posted]), np.concatenate([p[1] for p in posted])
    place = np.concatenate([p[3].astype(np.int64) + at for p, at in zip(posted, base[:-1], strict=True)])
    times = np.concatenate([p[4] for p in posted]).astype(np.float64)
    del posted
    order = np.argsort(keys, kind="stable")
    keys, place, times = keys[order], place[order], times[order]
    marks = flags[place]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    seen = [np.add.reduceat(times * (marks & bit > 0), first) for bit in (1, 2)]
    told = np.repeat(seen[1] >= LEAST, np.diff([*first, len(keys)]))
    number = np.repeat(np.arange(len(first)), np.diff([*first, len(keys)]))[told]
    place, times = place[told], times[told]
    # equal texts have one id and one answer
    order = np.lexsort((every[place], number))
    place, times, number = place[order], times[order], number[order]
    once = np.ones(len(place), bool)
    once[1:] = (every[place[1:]] != every[place[:-1]]) | (number[1:] != number[:-1])
    place, times, number = place[once], times[once], number[once]
    lead = keys[first]
    rare = lead >= _RARE
    a, b = (np.where(rare, 0, x).astype(np.int64) for x in (lead >> np.uint64(32), lead & np.uint64(0xFFFFFFFF)))
    sums = []
    for side in range(2):
        change = models.rare_change(side, seen[side])
        if len(models.words):
            change = np.where(rare, change, models.bigram_change(side, a, b, seen[side]))
        sums.append(np.bincount(place, times * change[number], len(every)))
    own = np.unique(place)
    cuts = np.searchsorted(own, base)
    data, of = [], []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = own[cuts[k] : cuts[k + 1]]
        data.append(_packed(every[at], *(x[at].astype(np.float32) for x in sums)))
        of.append(blocks[k])
    return _answers(of, data, hot.astype(np.int32), *totals)


def _changed(table: pa.Table) -> pa.Table:
    """Of the answers to one block: the changes of each text."""
    ids, *sums = (np.concatenate(x) for x in zip(*(_unpacked(x.as_py(), np.int64, np.float32, np.float32) for x in table.column("data")), strict=True))
    each, inverse = np.unique(ids, return_inverse=True)
    return pa.table([pa.array(each), *(pa.array(np.bincount(inverse, x, len(each))) for x in sums)], names=["id", *SIDES])


def _based(batches: Iterable[pa.RecordBatch], at: int, kept: list[int], shared, hot_changes, block: int) -> Iterator[pa.RecordBatch]:
    """The kept columns, the number of words and the sums of the losses that words and frequent bigrams give."""
    models, changes = shared.value, hot_changes.value
    alone = [-np.log(np.append(models.alone(s, models.counts[s]), models.alone(s, models.unknown[s]))) for s in range(2)]
    for batch in batches:
        for b in _blocks(batch.column(at), block):
            w, pairs = models.told(b.h), b.pairs()
            pairs = pairs[(w[pairs] >= 0) & (w[pairs - 1] >= 0)]
            hot = _place(models.hot, pair_keys(b.h[pairs - 1], b.h[pairs]))
            sums = []
            for s in range(2):
                loss = alone[s][w]
                if len(pairs):
                    loss[pairs] -= np.where(models.counts[s][w[pairs - 1]] > 0, np.log(1 - MIX), 0.0)
                    loss[pairs] += np.where(hot >= 0, np.append(changes[s], 0.0)[hot], 0.0)
                sums.append(np.bincount(b.doc, loss, b.size).astype(np.float64))
            arrays = [batch.column(i).slice(b.begin, b.size) for i in kept]
            arrays += [pa.array(np.bincount(b.doc, minlength=b.size).astype(np.int64)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[i] for i in kept), "_lm_n", "_lm_target", "_lm_background"])


def count_words(rows: DataFrame, rate: float = RATE, hot: float = HOT, block: int = BLOCK) -> Models:
    """The models' words over all of ``rows`` (text, target, background), and which bigrams are frequent."""
    counted = rows.mapInArrow(lambda b: _counted(b, hot, block), "first long, word long, target long, background long")
    table = stored(counted.groupBy("first", "word").agg(*[F.sum(s).alias(s) for s in SIDES]), "words")
    told, alone = F.col("background") >= LEAST, F.col("first").isNull()
    of = [F.coalesce(F.sum(F.when(told, 0).otherwise(F.col(s)) if rest else F.col(s)), F.lit(0)).alias(f"{s}_{rest}") for rest in (False, True) for s in SIDES]
    sums = table.where(alone).agg(F.count_if(told).alias("n"), *of).first()
    total = sums["background_False"]
    # at most 1/rate words and 2/hot bigrams; a bigram that is frequent in the corpus is so in most blocks
    listed = table.where(F.when(alone, F.col("background") >= max(LEAST, rate * total)).otherwise(F.col("background") >= hot * total / 2)).toArrow()
    pair, keys = ~listed["first"].is_null().to_numpy(), listed["word"].to_numpy().view(np.uint64)
    counts = np.stack([listed[s].to_numpy().astype(np.float64) for s in SIDES])[:, ~pair]
    order = np.argsort(keys[~pair])
    words = keys[~pair][order]
    first, word = listed["first"].filter(pa.array(pair)).to_numpy().view(np.uint64), keys[pair]
    a, b = _place(words, first), _place(words, word)
    both = (a >= 0) & (b >= 0)
    hashes = pair_keys(first[both], word[both])
    by_hash = np.argsort(hashes)
    discard(table)
    of = lambda rest: np.array([float(sums[f"{s}_{rest}"]) for s in SIDES])
    return Models(words, counts[:, order], sums["n"], of(False), of(True), hashes[by_hash], np.stack([a[both], b[both]])[:, by_hash])


def score_documents(docs: DataFrame, target: Column, background: Column | None = None, text: str = "text", keep_text: bool = True, rate: float = RATE, hot: float = HOT, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``docs`` with the mean losses of both models and their difference.

    ``target`` is the condition of the target documents, ``background`` that of
    those that are counted at all (None: every one); others are scored only.
    Texts are known by a hash of 64 bits.
    """
    spark = docs.sparkSession
    rows = docs.drop(*ADDED, *[c for c in docs.columns if c.startswith("_lm_")])
    counts = F.coalesce(F.lit(True) if background is None else background, F.lit(False))
    asked = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("id"), F.col(text).alias("text"), (target & counts).alias("target"), counts.alias("background"))
    models = count_words(asked.select("text", *SIDES), rate, hot, block)
    shared = spark.sparkContext.broadcast(models)
    buckets = max(shuffle_partitions(spark), int(models.sums[1] // part) + 1)
    posted = asked.mapInArrow(lambda b: _posted(b, shared, buckets, block), "bucket long, block long, data binary")
    answers = stored(posted.groupBy("bucket").applyInArrow(lambda t: _answered(t, shared), ANSWER), "answers")

    # the frequent bigrams, by their numbers: as many as the list that is broadcast
    found = answers.where("hot is not null").toArrow()
    hot_counts = np.zeros((2, len(models.hot)))
    hot_counts[:, found["hot"].to_numpy()] = [found[s].to_numpy() for s in SIDES]
    changes = np.stack([np.where(hot_counts[1] >= LEAST, models.bigram_change(s, *models.hot_words, hot_counts[s]), 0.0) for s in range(2)]) if len(models.words) else hot_counts
    hot_changes = spark.sparkContext.broadcast(changes)

    rows = rows.withColumn("_lm_id", F.xxhash64(F.coalesce(text, F.lit(""))))
    at = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if keep_text or i != at]
    fields = [rows.schema.fields[i] for i in kept]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "_lm_n long, _lm_target double, _lm_background double"
    based = rows.mapInArrow(lambda b: _based(b, at, kept, shared, hot_changes, block), schema)
    changed = answers.where("hot is null").select("block", "data").groupBy("block").applyInArrow(_changed, "id long, target double, background double")
    changed = changed.groupBy(F.col("id").alias("_lm_id")).agg(*[F.sum(s).alias(f"_lm_{s}_change") for s in SIDES])
    done = based.join(changed, "_lm_id", "left")
    means = [(F.col(f"_lm_{s}") + F.coalesce(f"_lm_{s}_change", F.lit(0.0))) / F.when(F.col("_lm_n") > 0, F.col("_lm_n")) for s in SIDES]
    done = done.withColumns({"n_words": F.col("_lm_n"), "target_loss": means[0], "background_loss": means[1]})
    return done.withColumn("score", F.col("target_loss") - F.col("background_loss")).select(*[f"`{f.name}`" for f in fields if f.name != "_lm_id"], *ADDED)


def marked(docs: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``name`` (one of that name is replaced): true for the keys in ``ids``, null for others. The texts stay where they are unless the ids are many."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        return docs.drop(name).join(F.broadcast(ids), key, "left")
    return stored(docs.drop(name).join(ids, key, "left"), "marked")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its difference from the documents labelled as good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return score_documents(marked(docs, good, "good"), F.col("good"), keep_text=False).drop("good")
