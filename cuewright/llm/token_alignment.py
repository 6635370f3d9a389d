"""Cross-tokenizer alignment: tokens of two tokenizers that cover the same bytes.

Both tokenizers read the same bytes, a blank and the text. Per slice of texts,
laid end to end: ends of tokens are cumulative sums of their sizes; where both
have an end is a cut (``intersect1d``); a token's group is the number of cuts
before it (``searchsorted``); each token of A is repeated for every token of B
that overlaps it, which gives the links.

Pairs of ids are counted by documents. Each task adds up a slice's pairs first;
the sums meet under a salt, then without it, so that no task gets a frequent
pair's rows. Counts of frequent pairs go to the tasks as one sorted array, of at
most ``MOST_PAIRS``; links of all other pairs meet their counts in a join.

Defined cases: a text that is null, empty, or that a tokenizer does not give
back byte by byte (B changes U+2581) has no tokens: zeros and an empty digest;
strings of special tokens are plain text; repeated rows each count as a
document; null keys stay; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.llm.kernels import text_slices
from cuewright.llm.pieces import byte_to_char
from cuewright.llm.scratch import stored
from cuewright.llm.token_files import library_encoder

#: Pairs whose counts are broadcast, at 17 bytes each; links of others meet them in a join.
MOST_PAIRS = 2_000_000
#: First stage of the sums of a pair.
SALTS = 16


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begin`` on, ``size`` of them, end to end."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Tokens:
    """A tokenizer's ids of many texts, and the bytes that each id stands for."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin = np.cumsum([0, *map(len, pieces)])
        self.size = np.diff(self.begin)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.begin[ids], self.size[ids])]


class ByteLevel(Tokens):
    """A byte-level BPE tokenizer file of the tokenizers library, over a blank and the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        back = {c: b for b, c in enumerate(byte_to_char())}
        entries = sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        pieces = [b""] * (entries[-1][1] + 1)
        for entry, k in entries:
            pieces[k] = bytes(back[c] for c in entry) if all(c in back for c in entry) else b""
        super().__init__(pieces)
        self._encoder = library_encoder(tokenizer)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = list(self._encoder.encode(pa.array([f" {t}" for t in texts])))
        sizes = np.concatenate([np.diff(off) for _, _, off in parts])
        return np.concatenate([ids for _, ids, _ in parts]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Pieces(Tokens):
    """A sentencepiece model with byte fallback, which puts the blank before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = m = SentencePieceProcessor(model_file=path)
        named = [m.id_to_piece(k) for k in range(m.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if m.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(named)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self._model.encode(texts, out_type=int, num_threads=1)
        off = np.cumsum([0, *map(len, lists)])
        return np.fromiter(chain.from_iterable(lists), np.int64, int(off[-1])), off


@dataclass(frozen=True)
class Aligned:
    """Texts of a slice: offsets of their tokens in ``a`` and ``b``, groups of the tokens, and links as places in both."""

    a: np.ndarray
    a_off: np.ndarray
    b: np.ndarray
    b_off: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_off: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray
    link_off: np.ndarray


def _kept(ids: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the tokens of texts that are not kept."""
    size = np.diff(off)
    return ids[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(np.where(keep, size, 0))])


def align(texts: list[str], first: Tokens, second: Tokens) -> Aligned:
    """Links and groups of the two tokenizers' tokens in each text."""
    raws = [f" {t}".encode() if t else b"" for t in texts]
    begin = np.cumsum([0, *map(len, raws)])
    whole = np.frombuffer(b"".join(raws), np.uint8)
    keep, sides = begin[1:] > begin[:-1], []
    for tokens in (first, second):
        ids, off = _kept(*tokens.encode(texts), keep)
        ends = np.concatenate([[0], np.cumsum(tokens.size[ids])])[off]
        size = np.diff(begin)
        same = np.diff(ends) == size
        # texts of the right size are compared byte by byte, each where it stands
        unlike = tokens.bytes_of(ids)[_ranges(ends[:-1][same], size[same])] != whole[_ranges(begin[:-1][same], size[same])]
        unlike = np.concatenate([[0], np.cumsum(unlike)])
        at = np.concatenate([[0], np.cumsum(np.where(same, size, 0))])
        keep = keep & same & (unlike[at[1:]] == unlike[at[:-1]])
        sides.append((ids, off))
    (a, a_off), (b, b_off) = (_kept(ids, off, keep) for ids, off in sides)
    a_end, b_end = np.cumsum(first.size[a]), np.cumsum(second.size[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    # tokens of B that end beyond the start of one of A, up to those that begin before its end
    low = np.searchsorted(b_end, a_end - first.size[a], "right")
    high = np.searchsorted(b_end - second.size[b], a_end, "left")
    n = high - low
    ends, links = np.concatenate([[0], a_end])[a_off], np.concatenate([[0], np.cumsum(n)])[a_off]
    return Aligned(a, a_off, b, b_off, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), np.searchsorted(cuts, ends, "right"), np.repeat(np.arange(len(a)), n), _ranges(low, n), links)


class Groups:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, most: int):
        self._names = np.array([f"{k}{mark}" for k in range(most) for mark in ",|;"], "S")
        self._sizes = np.char.str_len(self._names)

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's groups; nothing for texts without tokens."""
        side = np.concatenate([np.zeros(len(x.a), np.int64), np.ones(len(x.b), np.int64)])
        place = np.concatenate([x.a_group, x.b_group]) * 2 + side
        order = np.argsort(place, kind="stable")
        place = place[order]
        mark = np.full(len(place), 2)
        mark[:-1] = np.where(place[1:] == place[:-1], 0, np.where(place[1:] // 2 == place[:-1] // 2, 1, 2))
        code = np.concatenate([x.a, x.b])[order] * 3 + mark
        joined = self._names[code].tobytes().replace(b"\0", b"")
        stop = np.concatenate([[0], np.cumsum(self._sizes[code])])[x.a_off + x.b_off].tolist()
        # without the mark after the last group
        return [hashlib.sha256(joined[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(stop[:-1], stop[1:], strict=True)]


def _aligned(batches: Iterable[pa.RecordBatch], a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    first, second = ByteLevel(a_file), Pieces(b_file)
    groups, of_b = Groups(max(len(first.size), len(second.size))), len(second.size)
    for batch in batches:
        for held, at in text_slices(batch.column(1)):
            x, n = align(held, first, second), len(held)
            doc = np.repeat(np.arange(n), np.diff(x.link_off))
            # each text's distinct pairs, as often as they are linked
            pairs, times = np.unique(doc * (len(first.size) * of_b) + x.a[x.a_link] * of_b + x.b[x.b_link], return_counts=True)
            doc, pairs = np.divmod(pairs, len(first.size) * of_b)
            off = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            own = [np.diff(x.a_off), np.diff(x.b_off), np.diff(x.group_off), np.diff(x.link_off), groups.digests(x)]
            lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (pairs, times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *map(pa.array, own), *lists], names=["_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _summed(batches: Iterable[pa.RecordBatch], salts: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(pair, salt, n): documents of the pairs of some batches."""
    salt, held, size = TaskContext.get().partitionId() % salts, [], 0

    def counted() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.full(len(pairs), salt, np.int32)), pa.array(n)], names=["pair", "salt", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size > most:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def pair_counts(aligned: DataFrame, b_size: int, salts: int = SALTS) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""
    some = aligned.select("pairs").mapInArrow(lambda b: _summed(b, salts), "pair long, salt int, n long")
    counts = some.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.floor(F.col("pair") / b_size)), "pair-counts")
    # one row for each A id: as many as its vocabulary has
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums over the links of broadcast pairs, and the other pairs with their links."""
    known, n, best = shared.value
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            rows = batch.slice(k, 1000)
            lists, times = rows.column(5), rows.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            of = lambda v: np.diff(np.concatenate([[0], np.cumsum(np.where(hit, v, 0))])[off])
            sums = (of(best[at] * times), of(n[at] * times)) if len(known) else (np.zeros(rows.num_rows, np.int64),) * 2
            rest = np.concatenate([[0], np.cumsum(~hit)])[off]
            entries = pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(times[~hit])], names=["pair", "times"])
            left = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], rows.column(7), *map(pa.array, sums), left], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_key", "n_best", "count_sum", "rest"])


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS, salts: int = SALTS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Texts are read and encoded once; their distinct pairs are kept in a table,
    as ids of all links are not needed again.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("_key"), F.col(text))
    sizes = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links"))
    aligned = stored(rows.mapInArrow(lambda b: _aligned(b, a_file, b_file), f"_key {kind}, {sizes}, groups_sha256 string, pairs array<long>, times array<int>"), "aligned")
    counts = stored(pair_counts(aligned, len(Pieces(b_file).size), salts), "pairs")
    # the least count whose pairs are few enough
    cut = 1
    while (few := counts.where(F.col("n") >= cut)).count() > most_pairs:
        cut *= 2
    table = few.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    read = aligned.select(*names, "pairs", "times", "_key")
    told = read.mapInArrow(lambda b: _looked_up(b, shared), f"{sizes}, groups_sha256 string, _key {kind}, n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    if cut > 1:
        told = _with_rest(told, counts.where(F.col("n") < cut))
    return told.select(F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_rest(told: DataFrame, counts: DataFrame) -> DataFrame:
    """The sums with those over pairs that are not broadcast: each is in fewer documents than those, so no key is hot."""
    told = stored(told.withColumn("_row", F.monotonically_increasing_id()), "told")
    links = told.select("_row", F.explode("rest").alias("e")).select("_row", "e.pair", "e.times")
    more = links.join(counts, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    added = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
    return told.join(more, "_row", "left").withColumns({"n_best": added("n_best", "_best"), "count_sum": added("count_sum", "_sum")})


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two public tokenizers, aligned."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
