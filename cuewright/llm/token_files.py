"""Token-ID output: Parquet files of id lists for selective reads.

Layout of a file: rows in ascending document order; ``token_ids`` a list column
in dictionary encoding (a public vocabulary has at most some ten thousand ids,
so a page of ids packs into about two bytes each); the integer columns in delta
encoding; row groups and pages of a stated size; column and offset indexes, so
that a reader who wants some documents, or only the sizes, fetches those pages.

Defined cases: a null or empty text has the end id only; a null key comes
first; repeated rows stay, each with its own place; rows of one key are ordered
by hashes of their texts and other columns; a text that holds an added token of
the tokenizer gets the library's own ids; an empty table gives an empty result;
other columns go along as metadata unless they clash with the layout's own
names (``part``, ``local_start``, ``n_tokens``, ``token_ids``) or the reader's
(``start``, ``_before``), then they are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from cuewright.llm.pieces import PieceEncoder, byte_to_char
from cuewright.llm.scratch import fresh_path, shuffle_partitions

LAYOUT = ("part", "local_start", "n_tokens", "token_ids")
#: Files whose counts are broadcast to a reader; those of more are joined by a shuffle.
BROADCAST_FILES = 1_000_000


class LibraryEncoder:
    """Encodes texts as the tokenizers library does: by pieces, but for texts that hold an added token, which it gets whole."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.pieces = library_encoder(self.whole)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of a batch: (index of the first text, ids, offsets of the texts in them)."""
        held = np.zeros(len(texts), bool)
        for token in self.added:
            held |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(held), "", texts) if held.any() else texts
        for first, ids, off in self.pieces.encode(plain):
            own = np.flatnonzero(held[first : first + len(off) - 1])
            if len(own):
                lists = np.split(np.asarray(ids), off[1:-1])
                for i in own.tolist():
                    lists[i] = np.array(self.whole.encode(texts[first + i].as_py(), add_special_tokens=False).ids, ids.dtype)
                ids, off = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            yield first, ids, off


def library_encoder(tokenizer) -> PieceEncoder:
    """Encodes pieces by the merges of a byte-level BPE tokenizer of the tokenizers library."""
    model, table = tokenizer.model, byte_to_char()

    def encode(pieces: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize("".join([table[b] for b in p.encode()]))] for p in pieces]

    return PieceEncoder(encode)


def _encoded(batches: Iterable[pa.RecordBatch], names: list[str], text: str, tokenizer_file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part, at = LibraryEncoder(tokenizer_file), TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        for first, ids, off in encoder.encode(texts):
            n = len(off) - 1
            # the end id follows each document's ids
            out = np.insert(ids, off[1:], end_id).astype(np.int32)
            off = off + np.arange(n + 1)
            sizes = np.diff(off)
            own = [batch.column(batch.schema.get_field_index(c)).slice(first, n) for c in names]
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(out))
            own += [pa.array(np.full(n, part, np.int32)), pa.array(at + off[:-1]), pa.array(sizes), lists]
            at += int(off[-1])
            yield pa.RecordBatch.from_arrays(own, names=[*names, *LAYOUT])


def write_token_ids(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 128 << 10,
    partitions: int | None = None,
) -> None:
    """Encode every whole text and write the layout above to ``path``, in ascending order of ``key``.

    One shuffle, of the texts by ranges of the key; encoding, the end ids and
    the running starts of a part follow in the same stage as the write.
    """
    names = [c for c in docs.columns if c != text and c not in (*LAYOUT, "start", "_before")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text), F.lit("")).alias(text))
    n = partitions or shuffle_partitions(docs.sparkSession)
    # rows of one key are told apart by their contents, so that many of them don't fall in one range
    order = [F.col(key), F.xxhash64(text), F.xxhash64(*[F.col(f"`{c}`") for c in names])]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    layout = [T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + layout)
    encoded = rows.mapInArrow(lambda batches: _encoded(batches, names, text, tokenizer_file, end_id), schema)
    writer = encoded.write.option("compression", "zstd")
    for name, value in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#token_ids.list.element": "true",
    }.items():
        writer = writer.option(name, str(value))
    writer.parquet(path)


def read_token_ids(spark: SparkSession, path: str, columns: list[str] | None = None, keys: tuple[object, object] | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of written files with ``start``, the count of ids before each document in the whole order.

    ``keys`` (least, most) and ``columns`` reach the Parquet scan: other row
    groups, pages and columns are not read. The starts come from one number a
    file, which is what is broadcast.
    """
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    # one row a file, in one window
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before"))
    rows = files.where(F.col(key).between(*keys)) if keys else files
    few = sizes.count() <= BROADCAST_FILES
    rows = rows.join(F.broadcast(before) if few else before, "part").withColumn("start", F.col("_before") + F.col("local_start"))
    return rows.select(*(columns or [c for c in rows.columns if c not in ("part", "local_start", "_before")]))


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        lists = batch.column(3)
        ids, off = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back: place, size and checksum of its ids."""
    import public_tokenizers

    path = fresh_path(spark, "token-ids")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    write_token_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    rows = read_token_ids(spark, path, ["doc_id", "start", "n_tokens", "token_ids"])
    return rows.mapInArrow(_digested, "doc_id long, start long, n_tokens long, ids_crc32 long")
