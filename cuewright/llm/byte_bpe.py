"""Byte-level BPE with a sentencepiece model serialised from a rank vocabulary.

The model holds one piece for each rank: the piece's bytes mapped to the public
byte-level alphabet, scored by its negative rank, in rank order, so that piece
numbers are the ranks. Normalisation is the identity: no dummy prefix, no
escaped or collapsed blanks. A text is cut into pre-tokens, each is encoded
separately, and ids decode by the inverse of the byte mapping.

Defined cases: a null or empty text has no ids; encoding gives no id without a
piece, as all 256 bytes are pieces, and decoding refuses one; null ids of a row
decode to an empty text; repeated rows and null keys stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuewright.llm.kernels import released
from cuewright.llm.pieces import PieceEncoder, byte_to_char


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece BPE model of a rank vocabulary, with the unknown piece after the last rank."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    table, model = byte_to_char(), proto.ModelProto()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    for piece, rank in ordered:
        model.pieces.add(piece="".join([table[b] for b in piece]), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="unknown", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    trainer, normal = model.trainer_spec, model.normalizer_spec
    trainer.model_type = proto.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(ordered), -1, -1, -1
    trainer.unk_piece = "unknown"
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


class ByteBPE:
    """Encoder and decoder over a serialised model, for use in a task."""

    def __init__(self, ranks: dict[bytes, int]):
        from sentencepiece import SentencePieceProcessor

        table = byte_to_char()
        back = {c: b for b, c in enumerate(table)}
        model = SentencePieceProcessor(model_proto=serialised_model(ranks))
        pieces = [bytes(back[c] for c in model.id_to_piece(i)) for i in range(len(ranks))]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin = np.cumsum([0, *map(len, pieces)])

        def encode(texts: list[str]) -> list[list[int]]:
            raws = [t.encode() for t in texts]
            out = [[own] if (own := ranks.get(r)) is not None else [] for r in raws]
            rest = [i for i, own in enumerate(out) if not own]
            mapped = ["".join([table[b] for b in raws[i]]) for i in rest]
            for i, ids in zip(rest, model.encode(mapped, out_type=int, num_threads=1) if rest else [], strict=True):
                out[i] = ids
            return out

        self.encoder = PieceEncoder(encode)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids and the offsets of the documents in them."""
        size = (self.begin[1:] - self.begin[:-1])[ids]
        cum = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.begin[ids] - cum[:-1], size) + np.arange(cum[-1])], cum[off]


def _encoded(batches: Iterable[pa.RecordBatch], key: list[str], ranks_file: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBPE(read_ranks(ranks_file))
    for batch in batches:
        for first, ids, off in bpe.encode(batch.column(len(key))):
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([c.slice(first, len(off) - 1) for c in batch.columns[: len(key)]] + [lists], names=[*key, "token_ids"])


def encode_texts(docs: DataFrame, ranks_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``token_ids`` (one of that name is replaced), the ids of each whole text. No shuffle."""
    keep = [c for c in (keep or docs.columns) if c not in (text, "token_ids")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: released(_encoded(b, keep, ranks_file)), f"{schema}, token_ids array<int>")


def _decoded(batches: Iterable[pa.RecordBatch], at: int, ranks_file: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBPE(read_ranks(ranks_file))
    for batch in batches:
        lists = batch.column(at)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(bpe.begin) - 1:
            raise ValueError("an id that no piece has")
        raw, off = bpe.decode(ids, np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts), *batch.columns[at + 1 :]], names=[*batch.schema.names[:at], "text", *batch.schema.names[at + 1 :]])


def decode_ids(rows: DataFrame, ranks_file: str, ids: str = "token_ids") -> DataFrame:
    """``ids`` replaced by ``text``, decoded by the inverse byte mapping; a column ``text`` of the rows goes."""
    rows = rows.drop("text") if ids != "text" else rows
    at = rows.columns.index(ids)
    schema = ", ".join("text string" if f.name == ids else f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda b: _decoded(b, at, ranks_file), schema)


def _digested(batches: Iterable[pa.RecordBatch], ranks_file: str) -> Iterator[pa.RecordBatch]:
    bpe = ByteBPE(read_ranks(ranks_file))
    for batch in batches:
        for first, ids, off in bpe.encode(batch.column(1)):
            raw, at = bpe.decode(ids, off)
            ids = ids.astype("<u4")
            n = len(off) - 1
            of = lambda x, o: [hashlib.sha256(x[a:b].data).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(off)), pa.array(of(ids, off)), pa.array(of(raw, at))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: digests of its ids and of the decoded bytes.

    Encoding and decoding are narrow, so the query digests both in one pass and never moves the ids.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(lambda b: _digested(b, ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
