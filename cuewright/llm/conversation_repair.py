"""Conversation structure repair by dynamic programming along a trie of signatures.

A row's role and fault are one letter, a conversation's letters in order are its
signature. A repair makes the roles read ``s?`` and pairs ``ua`` (or nothing),
at least cost. Conversations of one signature share their cheapest edits, and
signatures of a common prefix share the layers of the program along it:

1. Rows become facts (turn, role, digest of the text, fault), without texts.
   What was seen earlier is told by the least turn of each role and digest.
2. Facts are sorted by ranges, so that a long conversation may lie in many
   tasks; each lays its letters end to end, and the parts make the signature.
3. Distinct signatures, sorted, are paths of a prefix trie in depth-first order.
   A stack holds the layers of the path; what two neighbours share stays on it.
   Answers are read at terminal nodes, backwards along the stack.
4. Answers and rows meet sorted by conversation, and the repaired lines stream
   into a digest: one row and one answer are held at a time.

A layer (cost and order of the best edits up to each state) is one of few but
for a common addend, so its successors are kept by letter and looked up.

Defined cases: a null role or text is one blank; null conversation ids are one
conversation; null turns come first; rows of one turn follow each other by role
and digest of the text; repeated rows count as duplicates; a conversation
without rows has zeros, no edits and the digest of nothing; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuewright.llm.scratch import discard, shuffle_partitions, stored

#: Letters of a signature: four for each kind of role, in order of the faults.
ROLES, FAULTS = ("s", "u", "a", ""), ("", "blank", "duplicate", "truncated")
LETTERS = "abcdefghijklmnop"
#: Costs of the edits, and of keeping or reroling a truncated row.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
_SPACE = r"[\x20\x09-\x0D]"

# the states of s?(ua)+ : nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_CLOSED = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _next_role(state: int) -> str:
    return "a" if state == USER else "u"


def _moves(state: int, letter: int) -> Iterator[tuple[int, int, str]]:
    """(cost, state, edits) of what can be done with a row: edits end with the row's own; insertions stand before K and R only.

    An insertion before D costs as much after it, and D comes first of the two.
    A second insertion in a row would lead back to a state at a higher cost.
    """
    role, fault = ROLES[letter // 4], FAULTS[letter % 4]
    yield DELETE, state, "D"
    if fault in ("blank", "duplicate"):
        return
    extra = CUT if fault == "truncated" else 0
    inserted = _AFTER[_next_role(state)][state]
    for cost, at, edits in ((0, state, ""), (INSERT, inserted, "I")):
        if at in _AFTER.get(role, {}):
            yield cost + extra, _AFTER[role][at], edits + "K"
        yield cost + REROLE + extra, _AFTER[_next_role(at)][at], edits + "R"


class Program:
    """The layers that occur, by number, and what follows each under each letter."""

    def __init__(self):
        # a layer: for each state that is reached, its cost above the least and its place among the edits in ASCII order
        self._numbers: dict[tuple, int] = {}
        self._layers: list[tuple] = []
        self._steps: dict[tuple[int, int], tuple[int, int, dict[int, tuple[int, str]]]] = {}
        self.root = self._number(((START, 0, 0),))

    def _number(self, layer: tuple) -> int:
        if layer not in self._numbers:
            self._numbers[layer] = len(self._layers)
            self._layers.append(layer)
        return self._numbers[layer]

    def step(self, layer: int, letter: int) -> tuple[int, int, dict[int, tuple[int, str]]]:
        """(next layer, what is added to all its costs, state -> (state before, edits))."""
        known = self._steps.get((layer, letter))
        if known is not None:
            return known
        best: dict[int, tuple] = {}
        for state, cost, place in self._layers[layer]:
            for more, after, edits in _moves(state, letter):
                # no two edit lists up to here are prefixes of each other, so their places decide
                tried = (cost + more, place, edits, state)
                if after not in best or tried < best[after]:
                    best[after] = tried
        least = min(x[0] for x in best.values())
        order = {after: k for k, after in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        following = self._number(tuple((s, best[s][0] - least, order[s]) for s in sorted(best)))
        self._steps[layer, letter] = following, least, {s: (x[3], x[2]) for s, x in best.items()}
        return self._steps[layer, letter]

    def final(self, layer: int) -> tuple[int, int]:
        """(state, cost above the layer's addend) of the cheapest edits of a conversation that ends here."""
        cost, _, state = min((cost + INSERT * len(_CLOSED[state]), place, state) for state, cost, place in self._layers[layer])
        return state, cost


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Trie:
    """The path of the trie that is being walked: its layers and the sums of their addends."""

    def __init__(self):
        self.program, self.path, self.built = Program(), "", 0
        self.layers, self.costs = [self.program.root], [0]

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; layers of the prefix that it shares with the one before are not computed again."""
        keep = _shared(self.path, signature)
        del self.layers[keep + 1 :], self.costs[keep + 1 :]
        layer, cost, step = self.layers[-1], self.costs[-1], self.program.step
        for c in signature[keep:].encode():
            layer, more, _ = step(layer, c - 97)
            cost += more
            self.layers.append(layer)
            self.costs.append(cost)
        self.built += len(signature) - keep
        self.path = signature
        state, more = self.program.final(layer)
        edits = [_CLOSED[state]]
        for k in range(len(signature), 0, -1):
            state, own = step(self.layers[k - 1], ord(signature[k - 1]) - 97)[2][state]
            edits.append(own)
        return cost + more, "".join(reversed(edits))


def _counts(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of a signature."""
    x = np.frombuffer(signature.encode(), np.uint8) - 97
    faults, roles = np.bincount(x % 4, minlength=4), x // 4
    pair = roles[:-1] * 4 + roles[1:]
    legal = np.isin(pair, [ROLES.index(a) * 4 + ROLES.index(b) for a, b in ("su", "ua", "au")])
    return int(faults[1]), int(faults[2]), int(faults[3]), int((~legal).sum())


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            rows = [(s, *_counts(s), *trie.answer(s)) for s in batch.column(0).slice(k, 1000).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each distinct one of ``signatures`` (signature)."""
    distinct = signatures.select("signature").distinct()
    paths = distinct.repartitionByRange(shuffle_partitions(signatures.sparkSession), "signature").sortWithinPartitions("signature")
    return paths.mapInArrow(_answers, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def damaged(rows: DataFrame, faults: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with every ``faults``-th row dropped, emptied, stripped of ends, repeated or made the user's, by a checksum of its place."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place) % faults).alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, digest, n, letter, again): equal rows once, with their letter and that of their repetitions; and the table it reads."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(rf"[.!?]{_SPACE}*\z")
    own = F.when(blank, 1).when(ends, 0).otherwise(3)
    counted = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), own.alias("own"))
    counted = stored(counted.groupBy("conv_id", "turn", "role", "digest", "own").agg(F.count(F.lit(1)).alias("n")), "facts")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"))
    met = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    kind = F.lit(len(ROLES) - 1)
    for k, initial in enumerate(ROLES[:-1]):
        kind = F.when(F.substring("role", 1, 1) == initial, k).otherwise(kind)
    letter = lambda fault: F.substring(F.lit(LETTERS), kind * 4 + fault + 1, F.lit(1))
    repeated = F.when(F.col("own") == 1, 1).otherwise(2)
    fault = F.when(turn.eqNullSafe(F.col("first")), F.col("own")).otherwise(repeated)
    return met.select("conv_id", "turn", "role", "digest", "n", letter(fault).alias("letter"), letter(repeated).alias("again")), counted


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of the stretches of one conversation within a batch, numbered in order."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
        texts = [a + b * (n - 1) for n, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        joined = ["".join(texts[a:b]) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(texts)], strict=True)]
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(begin)), pa.array(np.full(len(begin), part, np.int32)), pa.array(np.arange(number, number + len(begin))), pa.array(joined)], names=["conv_id", "part", "number", "letters"])
        number += len(begin)


def _repaired(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation follow its answer (the first ``width`` columns); the edits are carried out into a digest.

    Columns then: whether it is a row, its role, its text.
    """
    # the open conversation: its answer, edits, place in them, state, digest
    answer, edits, at, state, digest = None, "", 0, START, None
    done: list[tuple] = []

    def line(role: str, text: str) -> None:
        nonlocal first
        digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
        first = False

    def insert() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            line("assistant" if state == USER else "user", "")
            state, at = _AFTER[_next_role(state)][state], at + 1

    def close() -> None:
        if answer is not None:
            insert()
            if at != len(edits):
                raise ValueError("edits and rows of a conversation don't fit")
            done.append((*answer, digest.hexdigest()))

    first = True
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names[:width] + ["repaired_sha256"]
        schema = [f.type for f in list(batch.schema)[:width]] + [pa.string()]
        for k in range(0, batch.num_rows, 500):
            rows = batch.slice(k, 500).to_pydict()
            for values in zip(*rows.values(), strict=True):
                if not values[width]:
                    close()
                    answer, edits, at, state, digest, first = values[:width], values[width - 1] or "", 0, START, hashlib.sha256(), True
                    continue
                insert()
                role, text = values[width + 1 :]
                edit = edits[at]
                at += 1
                if edit == "K":
                    line(role, text)
                    state = _AFTER[role[:1]][state]
                elif edit == "R":
                    line("assistant" if state == USER else "user", text)
                    state = _AFTER[_next_role(state)][state]
            if len(done) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema, strict=True)], names=names)
                done = []
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema, strict=True)], names=names)


ANSWER = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, faults, cost, audit, repaired_sha256) of every id of ``ids`` (conv_id) over ``rows`` (conv_id, turn, role, text).

    Texts are shuffled once, to the digests. A conversation's digest and edits
    are single values over all of it, so one task streams its rows; signatures
    and faults come from tasks that hold a part of it.
    """
    spark = rows.sparkSession
    facts, held = _facts(rows)
    facts = stored(facts, "letters")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    laid = facts.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "n", "letter", "again")
    letters = laid.mapInArrow(_fragments, f"conv_id {dict(rows.dtypes)['conv_id']}, part int, number long, letters string")
    turns = facts.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
    none = F.lit(None)
    no_gaps, no_letters = none.cast("long").alias("gaps"), none.cast("struct<part:int,number:long,letters:string>").alias("f")
    every = ids.select("conv_id").distinct().select("conv_id", no_gaps, no_letters)
    gaps = turns.select("conv_id", (F.col("high") - F.col("low") + 1 - F.col("n")).alias("gaps"), no_letters)
    parts = letters.select("conv_id", no_gaps, F.struct("part", "number", "letters").alias("f"))
    told = every.unionByName(gaps).unionByName(parts).groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0)).alias("gaps"), F.array_join(F.array_sort(F.collect_list("f"))["letters"], "").alias("signature"))
    told = stored(told, "signatures")
    answers = stored(told.join(cheapest_edits(told), "signature").select("conv_id", *ANSWER, "audit"), "answers")
    discard(held, facts, told)
    keys = ["conv_id", *ANSWER, "audit"]
    lines = rows.select("conv_id", *[none.cast("long").alias(c) for c in ANSWER], none.cast("string").alias("audit"), F.lit(True).alias("_row"), "role", "text", "turn", _digest(F.col("text")).alias("digest"))
    heads = answers.select(*keys, F.lit(False).alias("_row"), *[none.cast("string").alias(c) for c in ("role", "text")], none.cast(dict(rows.dtypes)["turn"]).alias("turn"), none.cast("string").alias("digest"))
    dealt = heads.unionByName(lines).repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "_row", *order[1:])
    kinds = dict(rows.dtypes)
    schema = f"conv_id {kinds['conv_id']}, " + ", ".join(f"{c} long" for c in ANSWER) + ", audit string, repaired_sha256 string"
    return dealt.select(*keys, "_row", "role", "text").mapInArrow(lambda b: _repaired(b, len(keys)), schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule: its faults, cheapest edits and the digest of the repaired lines."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_conversations(damaged(rows), rows.select("conv_id"))
