"""Overlap joins against a plain loop, and a service as a table function."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators.intervals import overlapping
from cuewright.sources import providers, transcripts


@pytest.mark.parametrize("most", [100_000, 7])
@pytest.mark.parametrize("slack", [0.0, 1.5])
def test_overlaps_equal_the_loop(spark, slack, most):
    rng = random.Random(int(slack * 10) + most)
    span = lambda: rng.choice([(t := rng.randint(-5, 60) * 0.5, t + rng.choice([-1, 0, 0.5, 2, 30])), (t, t), (None, 1.0), (3.0, None)])
    left = [(rng.choice(["x", "x", "x", "y", None]), k, *map(lambda v: None if v is None else float(v), span())) for k in range(400)] + [("x", 500, 1.0, 2.0)] * 2
    right = [(rng.choice(["x", "y", "z", None]), k, *map(lambda v: None if v is None else float(v), span())) for k in range(250)]
    want = sorted((lk, rk) for a, lk, s, e in left for b, rk, u, v in right if a is not None and a == b and None not in (s, e, u, v) and max(s, e) + slack >= u and s - slack <= max(u, v))
    one = spark.createDataFrame(left, "k string, l int, a double, b double").repartition(3)
    other = spark.createDataFrame(right, "k string, r int, c double, d double").repartition(3)
    got = overlapping(one, other, ["k"], ("a", "b"), ("c", "d"), 4.0, slack, most)
    assert got.columns == ["k", "l", "a", "b", "r", "c", "d"]
    assert sorted((r["l"], r["r"]) for r in got.collect()) == want and len(want) > 200
    assert overlapping(one.where("false"), other, ["k"], ("a", "b"), ("c", "d"), 4.0).collect() == []
    with pytest.raises(ValueError):
        overlapping(one, other.withColumnRenamed("d", "b"), ["k"], ("a", "b"), ("c", "b"), 4.0)


BODIES = [
    '{"language":"en","text":"hi","segments":[{"start":1,"end":0.5,"text":" hi "},{"start":"2","end":"x","text":"there"},{"start":2,"end":3,"text":" "}]}',
    '{"text":"only text"}', '{"text":" "}', '{"segments":[{"start":0,"end":1,"text":" "}]}', "nonsense", "", "   ", None, "{}", "[1]",
]
WRAPPED = [
    '{"candidates":[{"content":{"parts":[{"text":"{\\"segments\\":[{\\"start\\":-1,\\"end\\":99,\\"text\\":\\"a\\"},"},{"text":"{\\"start\\":3,\\"end\\":2,\\"text\\":\\"b\\"}]}"}]}}]}',
    '{"candidates":[]}', '{"candidates":[{"content":{"parts":[{"text":" "}]}}]}', '{"candidates":[{"content":{"parts":[{"text":"{}"}]}}]}', '{"candidates":[{"content":{"parts":[{"text":"{\\"segments\\":[]}"}]}}]}', "nonsense", "", None,
]


@pytest.mark.parametrize("bodies, parse, native", [(BODIES, providers.verbose, transcripts.verbose_json), (WRAPPED, providers.candidates, transcripts.candidate_json)])
def test_both_readers_of_responses_tell_the_same(spark, bodies, parse, native):
    rows = spark.createDataFrame([(k, b, 30.0) for k, b in enumerate(bodies)], "id int, body string, duration_s double")
    for r in native(rows, "id").collect():
        _, timed, segments, error = parse(bodies[r["id"]], 30.0)
        assert error == r["error"], bodies[r["id"]]
        assert [tuple(s) for s in r["segments"] or []] == segments and (error or r["timed"] == timed)


def test_a_service_is_connected_once_a_worker(spark):
    import os
    import tempfile

    folder = tempfile.mkdtemp()

    def connect():
        open(os.path.join(folder, f"{os.getpid()}-{random.random()}"), "w").close()
        return lambda data: data.decode()

    providers.provide(spark, "test_heard", connect)
    clips = spark.createDataFrame([(k, bytearray(b'{"text":"x%d"}' % k), 2.0) for k in range(50)] + [(99, None, None)], "clip int, audio binary, d double").repartition(2)
    rows = spark.sql("SELECT c.clip, h.* FROM {clips} c, LATERAL test_heard(c.audio, c.d) h", clips=clips).collect()
    assert len(rows) == 51 and {r["text"] for r in rows if r["clip"] < 99} == {f"x{k}" for k in range(50)}
    assert [r["error"] for r in rows if r["clip"] == 99] == [transcripts.EMPTY]
    pids = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(pids) == len(set(pids))
    assert spark.sql("SELECT * FROM {clips} c LEFT JOIN LATERAL test_heard(c.audio, c.d) h", clips=clips.where(F.lit(False))).collect() == []
