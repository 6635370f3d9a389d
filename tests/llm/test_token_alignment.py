"""Alignment of two tokenizers against a plain version that walks bytes."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from cuewright.llm.byte_bpe import byte_to_char
from cuewright.llm.token_alignment import align_tokenizers, op12_token_alignment

DATA = "/root/testdata/sf0.001"
A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_to_char())}
    named = {v: bytes(back[c] for c in k) for k, v in a.get_vocab(with_added_tokens=False).items() if all(c in back for c in k)}

    def of_b(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    def spans(ids, size):
        out, at = [], 0
        for k in ids:
            out.append((k, at, at := at + len(size(k))))
        return out

    def one(text):
        """(tokens of A, of B, links, groups as text)"""
        nothing = [], [], [], None
        if not text:
            return nothing
        x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), f" {text}".encode()
        if b"".join(map(named.get, x)) != raw or b"".join(map(of_b, y)) != raw:
            return nothing
        x, y = spans(x, named.get), spans(y, of_b)
        links = [(i, j) for i, s, e in x for j, u, v in y if s < v and u < e]
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if low < e <= cut) for side in (x, y)))
            low = cut
        return x, y, links, groups

    def every(rows):
        told = [(k, *one(t)) for k, t in rows]
        count = Counter(p for *_, links, _ in told for p in set(links))
        most = Counter()
        for (i, _), n in count.items():
            most[i] = max(most[i], n)
        return sorted(((k, len(x), len(y), len(g or ()), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, x, y, links, g in told), key=str)

    return every


def test_op12_equals_the_plain_version(spark, plain):
    # the plain version compares all tokens of a text with all others, so long texts go
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").select("doc_id", "text")
    got = align_tokenizers(docs, A_FILE, B_FILE)
    assert got.columns == OUT
    assert sorted(map(tuple, got.collect()), key=str) == plain([tuple(r) for r in docs.collect()])
    assert op12_token_alignment(spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("most", [2_000_000, 40, 0])
def test_odd_rows_whatever_is_broadcast(spark, plain, most):
    rng = random.Random(3)
    letters = ["a", "the", " ", "  ", "\n", "\t", "\r", "é", "漢", "😀", "\x00", "<s>", "<0x41>", "<|endoftext|>", "Straße", "123", ".", " ", "ing", " ", "́"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁ a"), (104, "same"), (104, "same"), (None, "no key"), (105, " \n "), (106, "the the the")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    assert sorted(map(tuple, align_tokenizers(docs, A_FILE, B_FILE, most_pairs=most, salts=2).collect()), key=str) == plain(rows)


def test_a_long_text_and_no_text(spark):
    long = spark.createDataFrame([(1, "Ab cd's  12 \n" * 100_000)], "doc_id long, text string")
    row = align_tokenizers(long, A_FILE, B_FILE).first()
    assert row["n_a"] > 400_000 and row["n_links"] >= max(row["n_a"], row["n_b"]) and row["n_best"] > 0
    assert align_tokenizers(long.where("doc_id = 2"), A_FILE, B_FILE).collect() == []
