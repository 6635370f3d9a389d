"""License scans by diagonal voting.

1. Words of each whole text are hashed, and rolled into hashes of ``WIDTH``
   words in a row (of fewer, for shorter templates). Places whose hash is a
   template's are kept with the row; a row without any is done.
2. The places join the templates' positions. A place less its position in the
   template is a diagonal; votes are added up by row, template and diagonal.
3. Diagonals of a template that differ by little are merged: words that were
   put in or left out move what follows to a neighbour. How little depends on the template's
   length; a phrase of a few words allows nothing.
4. Spans are verified in the words themselves: the share of the template's words
   that stand in their place on one of the span's diagonals.

Templates are a parameter and few (``BROADCAST_POSITIONS`` checks it). Rows are
known by their place in a written table, so repeated rows and copies of a
text are cases of their own and no key is hot; only texts with a hit are
shuffled, once, to be verified.

Defined cases: a null or empty text has no words and no spans; null keys stay;
equal spans that several templates of a label find are all listed; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuewright.llm.kernels import batch_word_hashes, mix64, word_hashes
from cuewright.llm.license_texts import NOTICES, PHRASES
from cuewright.llm.scratch import stored

#: What stands between words: all of ASCII but digits and a to z, in lower-cased text.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Words that are hashed together; one step of a diagonal for so many words of a template; least share of a template's words.
WIDTH, WORDS_A_STEP, LEAST = 4, 16, 0.8
#: Positions of templates that are broadcast; more join by a shuffle.
BROADCAST_POSITIONS = 1_000_000


@dataclass(frozen=True)
class Template:
    """A phrase, whose words must all stand in a row, or a notice, of which a share must be found."""

    label: str
    words: tuple[bytes, ...]
    exact: bool

    @property
    def width(self) -> int:
        return min(WIDTH, len(self.words))

    @property
    def slack(self) -> int:
        """Most steps between neighbouring diagonals."""
        return 0 if self.exact else len(self.words) // WORDS_A_STEP


def words_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the lower-cased bytes, where words start, where they end)."""
    raw = text.encode().lower()
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = BETWEEN[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return raw, edge[0::2], edge[1::2]


def templates_of(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[Template]:
    """Templates of (label, text); those without words are left out."""
    found = []
    for exact, listed in ((True, phrases), (False, notices)):
        for label, text in listed:
            raw, starts, ends = words_of(text)
            found.append(Template(label, tuple(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), exact))
    return [t for t in found if t.words]


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row, from each word on that has so many after it."""
    n = max(len(h) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix64(out + h[k : k + n])
    return out


def positions(templates: list[Template]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, template, position) of all k-grams of the templates."""
    found = []
    for k, t in enumerate(templates):
        h = rolled(word_hashes(b" ".join(t.words).decode(), between=BETWEEN), t.width)
        found.append((h, np.full(len(h), k), np.arange(len(h))))
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def _scanned(batches: Iterable[pa.RecordBatch], widths: list[int], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each text: a number, its key, its words, its places of known hashes, and itself if it has any."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for first, h, off in batch_word_hashes(batch.column(1), BETWEEN):
            n, ends = len(off) - 1, np.repeat(off[1:], np.diff(off))
            at, which = [], []
            for width in widths:
                grams = rolled(h, width)
                hit = np.flatnonzero(np.isin(grams, known))
                hit = hit[hit + width <= ends[hit]]
                at.append(hit)
                which.append(grams[hit])
            at, which = np.concatenate(at), np.concatenate(which)
            order = np.argsort(at, kind="stable")
            at, which = at[order], which[order]
            of = np.searchsorted(at, off)
            places = at - np.repeat(off[:-1], np.diff(of))
            hits = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(which.view(np.int64)), pa.array(places)], names=["hash", "place"]))
            texts = batch.column(1).slice(first, n)
            texts = pa.array([texts[k].as_py() if some else None for k, some in enumerate((np.diff(of) > 0).tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n), pa.array(np.diff(off)), hits, texts], names=["_row", "_key", "n_words", "hits", "text"])
            row += n


def _verified(batches: Iterable[pa.RecordBatch], templates: list[Template]) -> Iterator[pa.RecordBatch]:
    """Spans of (key, words, text, [(template, diagonals)]) with the share of the template's words found there."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            rows, found = batch.slice(k, 100), []
            for text, spans in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                raw, starts, ends = words_of(text)
                own = []
                for s in spans:
                    t, seen, low, high = templates[s["template"]], set(), len(starts), 0
                    for d in s["diagonals"]:
                        for j in range(max(0, -d), min(len(t.words), len(starts) - d)):
                            if raw[starts[d + j] : ends[d + j]] == t.words[j]:
                                seen.add(j)
                                low, high = min(low, d + j), max(high, d + j + 1)
                    own.append({"label": t.label, "exact": t.exact, "start": low, "end": high, "share": len(seen) / len(t.words)})
                found.append([x for x in own if x["share"] > 0])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, kind)], names=["_key", "n_words", "spans"])


SPANS = "array<struct<label:string,exact:boolean,start:long,end:long,share:double>>"


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, key: str = "doc_id", text: str = "text", broadcast_positions: int = BROADCAST_POSITIONS) -> DataFrame:
    """(key, n_words, spans) of each row: every candidate span (label, exact, start, end, share), in words, by start, label and end.

    A phrase (``exact``) is there where its share is 1; of a notice, ``LEAST`` of the words should be.
    """
    templates = templates_of() if templates is None else templates
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    hashes, which, place = positions(templates)
    known, widths = np.unique(hashes), sorted({t.width for t in templates}) or [1]
    rows = docs.select(F.col(key).alias("_key"), F.col(text))
    scanned = stored(rows.mapInArrow(lambda b: _scanned(b, widths, known), f"_row long, _key {kind}, n_words long, hits array<struct<hash:long,place:long>>, text string"), "scanned")
    at = spark.createDataFrame(pa.table({"hash": hashes.view(np.int64), "template": which, "position": place, "slack": np.array([templates[k].slack for k in which], np.int64)}))
    at = F.broadcast(at) if len(hashes) <= broadcast_positions else at
    hits = scanned.select("_row", F.explode("hits").alias("h")).select("_row", "h.hash", "h.place")
    votes = hits.join(at, "hash").groupBy("_row", "template", "slack", (F.col("place") - F.col("position")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    beside = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(beside) > F.col("slack"), F.lit(True))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(beside))
    spans = merged.groupBy("_row", "template", "span").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    spans = spans.groupBy("_row").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))
    asked = scanned.where("text is not null").join(spans, "_row").select("_key", "n_words", "text", "found")
    told = asked.mapInArrow(lambda b: _verified(b, templates), f"_key {kind}, n_words long, spans {SPANS}")
    told = told.withColumn("spans", F.array_sort("spans", lambda x, y: F.when(_order(x) < _order(y), -1).when(_order(x) > _order(y), 1).otherwise(0)))
    rest = scanned.where("text is null").select("_key", "n_words", F.array().cast(SPANS).alias("spans"))
    return rest.unionByName(told).withColumnRenamed("_key", key)


def _order(span):
    return F.struct(span["start"], span["label"], span["end"], span["share"])


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["exact"] & (s["share"] == 1))
    good = F.filter("spans", lambda s: F.when(s["exact"], s["share"] == 1).otherwise(s["share"] >= LEAST))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    found = scan_licenses(docs).withColumns({"_base": base, "_good": good})
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda s: s["start"])).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"),
        labels(F.col("_good")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("_good", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
