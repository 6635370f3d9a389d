"""Token files, byte-level BPE and pieces against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
import regex

from cuewright.llm.byte_bpe import ByteBPE, decode_ids, encode_texts, op10_byte_bpe, read_ranks
from cuewright.llm.pieces import PieceEncoder, piece_starts
from cuewright.llm.token_files import op1_token_ids, read_token_ids, write_token_ids

DATA = "/root/testdata/sf0.001"
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def tiktoken_of(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_those_of_the_pattern():
    rng, pattern = random.Random(1), regex.compile(P.PATTERN)
    for _ in range(4000):
        t = "".join(rng.choice("ab sT'  \n\t's 're 'll've dé1²٣ 9.!,—漢\x1c\x85😀_-") for _ in range(rng.randint(1, 30)))
        starts = piece_starts(np.array([ord(c) for c in t], np.uint32), np.array([0])).tolist()
        assert [t[a:b] for a, b in zip(starts, [*starts[1:], len(t)])] == pattern.findall(t)


def test_long_text_is_cut_safely():
    text = "Ab cd's  12 \n" * 400_000
    seen = PieceEncoder(lambda ps: [[len(p)] for p in ps])
    (_, ids, off), = seen.encode(pa.array([text]))
    assert ids.sum() == len(text) and off[-1] == len(ids) == len(regex.findall(P.PATTERN, text))


def test_same_ids_as_tiktoken(docs):
    rng, theirs = random.Random(2), tiktoken_of(MULTI)
    texts = [r["text"] for r in docs.limit(60).collect()] + ["".join(chr(rng.choice([*range(1, 600), 0x4E00, 0x1F600, 0x2028])) for _ in range(80)) for _ in range(300)] + ["", None, "a" * 5000, " " * 300]
    ours, got = ByteBPE(read_ranks(MULTI)), []
    for _, ids, off in ours.encode(pa.array(texts)):
        raw, at = ours.decode(ids, off)
        got += [(ids[a:b].tolist(), raw[c:d].tobytes()) for a, b, c, d in zip(off[:-1], off[1:], at[:-1], at[1:])]
    assert got == [(theirs.encode_ordinary(t or ""), (t or "").encode()) for t in texts]


def test_op10(spark):
    theirs = tiktoken_of(MULTI)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op10_byte_bpe(spark, DATA).collect():
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_round_trip_of_odd_rows(odd, empty):
    rows = encode_texts(odd, MULTI)
    back = decode_ids(rows, MULTI).collect()
    assert sorted((r["text"], r["score"] or 0) for r in back) == sorted((r["text"] or "", r["score"] or 0) for r in odd.collect())
    assert encode_texts(empty, MULTI).count() == 0


def test_op1_and_the_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, start = docs.orderBy("doc_id").collect(), 0
    got = {r["doc_id"]: r for r in op1_token_ids(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        own = got[r["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)

    path = str(tmp_path / "t")
    write_token_ids(docs, path, P.path("byte_bpe_50k.json"), row_group_bytes=1 << 16, page_bytes=1 << 13, partitions=1)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["token_ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values()) and meta.num_row_groups > 1
    some = read_token_ids(spark, path, ["doc_id", "start", "lang"], keys=(10, 12))
    assert {r["doc_id"]: r["start"] for r in some.collect()} == {k: got[k]["start"] for k in (10, 11, 12)}
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    write_token_ids(odd.withColumnRenamed("score", "part"), str(tmp_path / "o"), P.path("byte_bpe_50k.json"))
    rows = read_token_ids(spark, str(tmp_path / "o")).orderBy("start").collect()
    assert len(rows) == 10 and rows[0]["doc_id"] is None and [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert next(r for r in rows if r["doc_id"] == 1)["token_ids"] == [0]
    write_token_ids(empty, str(tmp_path / "e"), P.path("byte_bpe_50k.json"))
    assert read_token_ids(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("bad", [{b"a": 1}, {b"a": 0, b"b": 2}])
def test_gaps_in_ranks_are_refused(bad):
    with pytest.raises(ValueError):
        ByteBPE(bad)


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    from cuewright.llm.token_files import LibraryEncoder

    path = P.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    texts = ["plain text", "a<|endoftext|>b", None, "", "<|endoftext|><|endoftext|> the end", "<|endof text|>", "x" * 50]
    got = [ids[a:b].tolist() for _, ids, off in LibraryEncoder(path).encode(pa.array(texts)) for a, b in zip(off[:-1], off[1:])]
    assert got == [theirs.encode(t or "", add_special_tokens=False).ids for t in texts] and got[1] == [64, 50256, 65]
