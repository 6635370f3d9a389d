"""Conversation repair against a brute force over all edits, a plain version of the query, and odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from cuewright.llm.conversation_repair import LETTERS, Trie, cheapest_edits, damaged, op11_conversation_repair, repaired_conversations

DATA = "/root/testdata/sf0.1"
GOOD = re.compile(r"(s?(ua)+)?\Z")
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def fault_of(rows):
    """(initial, fault) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((role[:1], "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, lines) of the cheapest edits of rows (role, text): best first over all edits, least audit of equal cost."""
    faults = fault_of(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if k == len(rows) and GOOD.match(roles):
            return cost, audit, lines
        if (audit, k, roles) in done or len(audit) > len(rows) * 2 + 3:
            continue
        done.add((audit, k, roles))
        if not re.match(r"(s?(ua)*u?)\Z", roles):
            continue
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", k, roles + r[0], (*lines, f"{r}:")))
        if k < len(rows):
            (role, text), (initial, fault) = rows[k], faults[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if initial:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, roles + initial, (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", k + 1, roles + r[0], (*lines, f"{r}:{text}")))
    raise AssertionError


def plain(rows):
    """The query's answers, from (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if what == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns, lines = [t for t, _, _ in own if t is not None], [r[1:] for r in own]
        faults = fault_of(lines)
        cost, audit, fixed = brute(lines)
        n = lambda kind: sum(f == kind for _, f in faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def signature(rows):
    kinds = {"s": 0, "u": 1, "a": 2}
    return "".join(LETTERS[kinds.get(i, 3) * 4 + ("", "blank", "duplicate", "truncated").index(f)] for i, f in fault_of(rows))


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "umpire"]), rng.choice(["a.", "b!", "c", " ", "", "d?", "e", "a."])) for _ in range(n)]


def test_edits_are_the_cheapest_and_least():
    rng, trie = random.Random(11), Trie()
    cases = [some_rows(rng, rng.randint(0, 5)) for _ in range(400)]
    for rows in cases:
        assert trie.answer(signature(rows)) == brute(rows)[:2], rows


def test_shared_prefixes_are_built_once():
    trie = Trie()
    for s in ("eiei", "eieiei", "eieiek", "ek"):
        trie.answer(s)
    assert trie.built == 4 + 2 + 1 + 1
    trie.answer("ei" * 100_000)
    assert trie.answer("ei" * 100_000 + "e") == (2, "K" * 200_001 + "I")


def test_op11_equals_the_plain_version(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = plain([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    got = op11_conversation_repair(spark, DATA)
    assert got.columns == OUT
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want and len(want) > 50


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice([None, "", " \n", "same.", "same.", "x", "Ä!", "end?  "])) for c in [None, *range(60)] for _ in range(rng.randint(1, 5))]
    rows += [(100, t, "user", "again.") for t in range(6)] + [(101, 1, "user", "twice.")] * 4
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, letter int, digest string")
    got = {r["conv_id"]: tuple(r[1:]) for r in repaired_conversations(damaged(table), table.select("conv_id")).collect()}
    assert got == plain(rows)


def test_a_long_conversation_over_many_tasks(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(3000)] + [(2, 0, "user", "Alone.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (one, two) = sorted(repaired_conversations(table, table).collect())
    assert tuple(one)[1:8] == (0, 0, 0, 0, 0, 0, "K" * 3000) and one[8] == hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert (two["cost"], two["audit"]) == (2, "KI")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired_conversations(damaged(none), none).collect() == []
    one = spark.createDataFrame([(7,)], "conv_id long")
    assert tuple(repaired_conversations(none, one).first()) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", [1, 5])
def test_signatures_meet_whatever_the_partitions(spark, n):
    rng = random.Random(n)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 6))) for _ in range(50)] * 2
    got = {r["signature"]: (r["cost"], r["audit"]) for r in cheapest_edits(spark.createDataFrame([(t,) for t in texts], "signature string").repartition(n)).collect()}
    assert got == {t: Trie().answer(t) for t in texts}
