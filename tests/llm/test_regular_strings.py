"""Strings of two letters whose polynomial hashes modulo a power of two are equal under every base."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.llm.byte_bpe import ByteBPE, read_ranks
from cuewright.llm.kernels import batch_word_hashes, span_hashes, word_hashes
from cuewright.llm.lm_score import score_documents
from cuewright.llm.ngram_jaccard import jaccard_components
from cuewright.llm.token_files import LibraryEncoder

from tests.llm.test_encoding import MULTI, tiktoken_of


def thue_morse(n: int, letters: str = "ab") -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048, 4096)]


def test_they_meet_under_the_cheap_hash():
    for a, b in PAIRS:
        points = np.frombuffer((a + b).encode(), np.uint8)
        h = span_hashes(points, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert h[0] == h[1]


@pytest.mark.parametrize("a, b", PAIRS)
def test_words_stay_apart(a, b):
    assert word_hashes(a)[0] != word_hashes(b)[0]
    (_, h, off), = batch_word_hashes(pa.array([f"x {a}", f"{a} {b}", b.upper()]))
    assert off.tolist() == [0, 2, 4, 5] and h[1] == h[2] and h[3] == h[4] != h[1]


@pytest.mark.parametrize("order", [1, -1])
def test_ids_are_the_libraries(order):
    from tokenizers import Tokenizer

    texts = [t for pair in PAIRS for t in pair[::order]] + [" ".join(t for pair in PAIRS for t in pair), "plain words"]
    ours, theirs = ByteBPE(read_ranks(MULTI)), tiktoken_of(MULTI)
    library, whole = LibraryEncoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for _ in range(2):  # again, from kept pieces
        for _, ids, off in ours.encode(pa.array(texts)):
            raw, at = ours.decode(ids, off)
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [theirs.encode_ordinary(t) for t in texts]
            assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts
        for _, ids, off in library.encode(pa.array(texts)):
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_they_are_not_linked(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for pair in PAIRS for t in pair)], "doc_id long, text string")
    got = jaccard_components(docs, width=3, percent=90).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_two_words_of_the_models(spark):
    a, b = PAIRS[0]
    docs = spark.createDataFrame([(1, f"{a} {a} x", True), (2, f"{b} {b} x x", False), (3, f"{a} {b}", True)], "doc_id long, text string, good boolean")
    other = docs.withColumn("text", F.replace(F.replace("text", F.lit(a), F.lit("one")), F.lit(b), F.lit("two")))
    losses = [{r["doc_id"]: r[side] for r in score_documents(d, F.col("good")).collect()} for side in ("target_loss", "background_loss") for d in (docs, other)]
    assert losses[0] == pytest.approx(losses[1]) and losses[2] == pytest.approx(losses[3])


def test_texts_in_pairs_are_blocks_of_their_own(spark):
    """Blocks whose texts occur twice each, or are one text over and over, are answered apart and score as the plain order does."""
    words = [f"w{k % 7} w{(k * 3) % 11} w{k % 5}" for k in range(40)]
    rows = [(2 * k + i, t, k % 3 == 0) for k, t in enumerate(words) for i in (0, 1)] + [(1000 + k, words[0], False) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").coalesce(1).sortWithinPartitions("doc_id")
    one, many = ({r["doc_id"]: r["score"] for r in score_documents(docs, F.col("good"), block=block).collect()} for block in (1_000_000, 4))
    assert one == pytest.approx(many) and len(one) == 120
