"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; other texts are unlabelled, a
mixture of both classes with a known share of positives. The risk of a
classifier on such data is corrected by that class prior:

    prior * E+[loss(g, +1)] + max(0, Eu[loss(g, -1)] - prior * E+[loss(g, -1)])

The second term estimates the risk on negatives, which cannot be below zero;
where a step would push it there, the step goes back instead. The classifier is
linear on the presence of hashed words, with the logistic loss, so that a score
is an estimate of the probability of the class. No confirmed negative is used:
the prior is given, or estimated as the least ratio of unlabelled to toxic
texts above a threshold of a first classifier, on texts that it was not fitted on.

Defined cases: a null or empty text has no words and gets the score of the bias
alone; without any confirmed toxic example, or any other text, the prior is zero
and so are all scores; repeated rows count as often as they occur, rows of one
key share its label, and of repeated labels any toxic one counts; null labels
are unlabelled; rows of a null key are scored only; a column ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuewright.llm.kernels import NO_WORD, batch_word_hashes, mix64, released
from cuewright.llm.scratch import discard, stored

#: Cells of the hashed vocabulary.
CELLS = 1 << 18
#: Most confirmed toxic rows, and most unlabelled rows, that a classifier is fitted on, taken in the order of a hash.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 24000


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def scores(self, cells: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[cells])])
        return 1 / (1 + np.exp(-np.clip(total[off[1:]] - total[off[:-1]] + self.bias, -40, 40)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, and the offsets of the texts in them."""
    parts, sizes = [], []
    for _, h, off in batch_word_hashes(texts, NO_WORD):
        cells = (h >> np.uint64(46)).astype(np.int64)
        n = len(off) - 1
        doc = np.repeat(np.arange(n), np.diff(off))
        both = np.unique(doc * CELLS + cells)
        parts.append((both % CELLS).astype(np.int32))
        sizes.append(np.bincount(both // CELLS, minlength=n))
    if not parts:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _margins(w: np.ndarray, b: float, cells: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[cells])])
    return total[off[1:]] - total[off[:-1]] + b


def _pick(cells: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = off[rows + 1] - off[rows]
    cum = np.concatenate([[0], np.cumsum(size)])
    return cells[np.repeat(off[rows] - cum[:-1], size) + np.arange(cum[-1])], cum


Rows = tuple[np.ndarray, np.ndarray]


def telling_cells(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, least_z: float = 3.0, least: int = 4) -> np.ndarray:
    """Cells whose share of the positives differs from their share of the unlabelled by ``least_z`` standard errors.

    The many others would carry noise into long texts; one of fewer than
    ``least`` occurrences on either side (for the other side's number of rows) says nothing.
    """
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    return (np.maximum(in_p, in_u * (n_p / n_u)) >= least) & (np.abs(in_p / n_p - in_u / n_u) >= least_z * np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """The non-negative risk of margins on positives and unlabelled."""
    return float(prior * _soft(-gp).mean() + max(0.0, _soft(gu).mean() - prior * _soft(gp).mean()))


def fit_nnpu(positive: Rows, unlabelled: Rows, prior: float, count: int, steps: int = 1500, rate: float = 0.03, decay: float = 2e-3, batch: int = 512, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``count`` features and the bias of least non-negative risk, by Adam on mini-batches."""
    n_p, n_u = len(positive[1]) - 1, len(unlabelled[1]) - 1
    rng = np.random.default_rng(seed)
    w, b = np.zeros(count), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, t = np.zeros(count), np.zeros(count), 0.0, 0.0, 0
    for done in range(steps):
        cu, ou = _pick(*unlabelled, rng.integers(0, n_u, min(n_u, batch)))
        cp, op = _pick(*positive, rng.integers(0, n_p, min(n_p, batch)))
        gp, gu = _margins(w, b, cp, op), _margins(w, b, cu, ou)
        negative = _soft(gu).mean() - prior * _soft(gp).mean()
        # d loss(g,+1) = sigmoid(g) - 1, d loss(g,-1) = sigmoid(g)
        dp_pos, dp_neg, du = prior * (_sigmoid(gp) - 1) / len(gp), -prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
        dp, du = (dp_pos + dp_neg, du) if negative >= 0 else (-dp_neg, -du)
        grad = np.bincount(cp, np.repeat(dp, np.diff(op)), count) + np.bincount(cu, np.repeat(du, np.diff(ou)), count) + decay * w
        gb = dp.sum() + du.sum()
        t += 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * (1 - done / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    # few steps leave small margins: scaled by the same risk on all rows, shifted so that the mean score is the prior
    gp, gu = _margins(w, b, *positive), _margins(w, b, *unlabelled)
    fits = []
    for a in np.linspace(1, 6, 21):
        low, high = -60.0, 60.0
        for _ in range(50):
            c = (low + high) / 2
            low, high = (c, high) if _sigmoid(a * gu + c).mean() < prior else (low, c)
        fits.append((risk(a * gp + c, a * gu + c, prior), a, c))
    _, a, c = min(fits)
    return a * w, float(a * b + c)


def estimated_prior(positive: Rows, unlabelled: Rows, count: int, start: float = 0.2) -> float:
    """The share of positives among the unlabelled, from above: the least ratio of both shares beyond a threshold.

    Each half of the rows is judged by a classifier of the other half.
    """
    halves = [[_pick(*rows, np.arange(k, len(rows[1]) - 1, 2)) for k in range(2)] for rows in (positive, unlabelled)]
    if any(len(off) < 2 for rows in halves for _, off in rows):
        return start
    margins: list[list[np.ndarray]] = [[], []]
    for k in range(2):
        w, b = fit_nnpu(halves[0][k], halves[1][k], start, count, steps=400)
        for at, rows in enumerate(halves):
            margins[at].append(_margins(w, b, *rows[1 - k]))
    gp, gu = (np.concatenate(x) for x in margins)
    bounds = np.quantile(gp, np.linspace(0.1, 0.5, 9))
    ratios = [(gu >= t).mean() / (gp >= t).mean() for t in bounds]
    return float(np.clip(min(ratios), 1 / (len(gu) + 1), 0.99))


def held_out(key: Column) -> Column:
    """Whether a key is in the quarter of crc32(key as text) mod 4 = 2, from which no label is learned."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(4)) == 2


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, off = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(cells))], names=["positive", "cells"])


def hash_of(cells: np.ndarray) -> int:
    return int(np.sum(mix64(cells)))


def _narrowed(batches: Iterable[pa.RecordBatch], used) -> Iterator[pa.RecordBatch]:
    keep = used.value
    place = (np.cumsum(keep) - 1).astype(np.int32)
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) if len(lists) else np.zeros(1, np.int64)
        told = keep[flat]
        cells, off = place[flat[told]], np.concatenate([[0], np.cumsum(told)])[off]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(cells))], names=["positive", "cells"])


def _some(rows: DataFrame, key: str, most: int, *tie: Column) -> DataFrame:
    """At most ``most`` rows in the order of a hash of the key; rows beyond about that many are filtered before they are sorted."""
    n = rows.count()
    order = F.xxhash64(F.col(key), F.lit("some"))
    if n > most:
        rows = rows.where(F.pmod(order, F.lit(1 << 40)) < int((most * 1.1 + 100) / n * (1 << 40)))
    return rows.orderBy(F.pmod(order, F.lit(1 << 40)), *tie).limit(most)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Linear:
    """Fit on documents outside the held-out quarter: those labelled as toxic, and any others without regard to labels.

    What reaches the driver is the telling words of a stated number of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null").where(~held_out(F.col("key")))
    toxic = labels.where(F.col(label) == 1).select(F.col(key).alias("key")).where("key is not null").where(~held_out(F.col("key"))).distinct()
    chosen = _some(toxic, "key", most_positive)
    mixed = _some(rows.select("key"), "key", most_unlabelled).groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    # at most the stated numbers of keys: broadcast, so that the texts stay where they are
    marks = chosen.withColumn("_p", F.lit(True)).join(mixed, "key", "full")
    picked = rows.join(F.broadcast(marks), "key").select("text", F.array_compact(F.array(F.when(F.col("_p"), True), F.when(F.col("_n").isNotNull(), False))).alias("_as"))
    featured = picked.select(F.explode("_as").alias("positive"), "text").mapInArrow(lambda b: released(_featured(b)), "positive boolean, cells array<int>")
    featured = stored(featured, "features")
    sizes = {r["positive"]: r["count"] for r in featured.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    nothing = Linear(np.zeros(CELLS), -40.0)
    if not n_p or not n_u or (prior is not None and not 0 < prior < 1):
        discard(featured)
        return nothing if prior is None or prior < 1 else Linear(np.zeros(CELLS), 40.0)
    counts = featured.select("positive", F.explode("cells").alias("cell")).groupBy("positive", "cell").count().toArrow()
    of = [np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)]
    for flag in (True, False):
        at = counts["positive"].to_numpy() == flag
        of[not flag][counts["cell"].to_numpy()[at]] = counts["count"].to_numpy()[at]
    used = telling_cells(*of, n_p, n_u)
    shared = spark.sparkContext.broadcast(used)
    got = featured.mapInArrow(lambda b: _narrowed(b, shared), "positive boolean, cells array<int>").toArrow()
    discard(featured)
    flags, lists = got["positive"].to_numpy(), got["cells"].combine_chunks()
    flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    # the same fit however the rows arrive
    digest = np.array([hash_of(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64)
    both = []
    for flag in (True, False):
        own = np.flatnonzero(flags == flag)
        both.append(_pick(flat, off, own[np.argsort(digest[own], kind="stable")]))
    count = int(used.sum())
    w, b = fit_nnpu(*both, prior=estimated_prior(*both, count) if prior is None else prior, count=count)
    weights = np.zeros(CELLS)
    weights[used] = w
    return Linear(weights, b)


def _scored(batches: Iterable[pa.RecordBatch], at: int, model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.value.scores(*features(batch.column(at)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def score_toxicity(docs: DataFrame, model: Linear, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; no shuffle, a model of fixed size is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score")
    at = rows.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda b: released(_scored(b, at, shared)), f"{schema}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a classifier fitted outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
