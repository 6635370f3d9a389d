"""Benchmark decontamination by templates, in DataFrame functions alone.

A text becomes a template: numbers, units after numbers, and names (capitalised
words) are replaced by typed placeholders, so that a question with other
parameters has the same template. Whether a capital makes a name is not certain,
so texts and items alike are read in two ways: without names, in lower case
(which finds text in capitals), and with every capitalised word as a name.
Adjacent words of a name are one placeholder. Windows of template words are hashed and joined within a reading;
a window of placeholders alone, as tables are full of, is told by its values.

On each alignment of a document with an item, the values behind the
placeholders must map consistently, both ways: one value of the item to one of
the document, and no other to that. Alignments that agree with the item's best
one in their values count together. An item counts as found if enough of its
windows are in one reading, and is reported by the reading that has the largest
share of them.

Defined cases: null or empty texts have no windows and items without words are
never found; an item of fewer words than a window (in a reading, of its
template) is one window of its own width, and one of fewer than ``LEAST`` is
found where it is a document's whole text; repeated rows of either side are
reported once; rows without a key are left out; an empty table on either side
gives an empty result; very long texts are read whole; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuewright.llm.scratch import stored

#: Words of a window; fewest words of an item that is looked for inside texts.
WIDTH, LEAST = 8, 5
#: An item is found with this share of its windows, or this number.
SHARE, ENOUGH = 0.5, 20
#: Rows that are broadcast; larger tables are joined by shuffles.
BROADCAST_ROWS = 1_000_000

# fixed values: units that may follow a number, and what is trimmed from words
UNITS = "% ° km cm mm m kg g mg lb lbs oz l ml h hr hrs hour hours min minute minutes s sec second seconds day days week weeks month months year years mile miles foot feet inch inches meter meters metre metres liter liters litre litres gram grams kilogram kilograms pound pounds dollar dollars cent cents euro euros percent".split()
MARKS = ".,;:!?\"'()[]{}$€£*#"


# groups repeat possessively: a long run of them takes no stack
_M, _BLANK = "[" + "".join("\\" + m for m in MARKS) + "]", "[\\x20\\x09-\\x0D]"
# a value stands between these behind its placeholder, where it is kept
_FROM, _TO = "\x01", "\x02"
_UNIT = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
NAME = "<name>"
#: Ways to read a text: capitals are words, capitals are names.
READINGS = (0, 1)


def _marked(text: Column, values: bool) -> Column:
    """A text in words between single blanks, after and before a blank, without marks at their ends; numbers and units replaced."""
    kept = lambda k: _FROM + f"${k}" + _TO if values else ""
    flat = F.coalesce(text, F.lit(""))
    flat = F.translate(flat, _FROM + _TO, "\x7f\x7f") if values else flat
    flat = F.regexp_replace(F.concat(F.lit(" "), flat, F.lit(" ")), f"{_M}*+(?:{_BLANK}+{_M}*+)++", " ")
    flat = F.regexp_replace(flat, " ([0-9](?:[.,:/]*[0-9])*+)", " <num>" + kept(1))
    unit = lambda t: F.regexp_replace(t, f"(<num>(?:{_FROM}[^ ]*{_TO})?)( ?)((?i:{_UNIT}))(?= )", "$1$2<unit>" + kept(3))
    return once(flat, lambda t: F.when(F.contains(t, F.lit("<num>")), unit(t)).otherwise(t))


def _reading(marked: Column, reading: int, values: bool) -> Column:
    """The template's words of a marked text in a reading; adjacent names are one, but where values are kept."""
    if reading:
        name = " ([\\p{Lu}\\p{Lt}][^ ]*)"
        marked = F.regexp_replace(marked, name if values else f"(?:{name})++", f" {NAME}" + (_FROM + "$1" + _TO if values else ""))
    return once(F.lower(F.btrim(marked, F.lit(" "))), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def templates(text: Column) -> Column:
    """An array of the hashes of the template's words, for each reading."""
    return once(_marked(text, False), lambda m: F.array(*[F.transform(_reading(m, r, False), lambda w: F.xxhash64(w)) for r in READINGS]))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slots(text: Column, reading: int) -> Column:
    """The (kind, value) of the template's words in a reading, with adjacent names merged."""
    kind = lambda w: F.regexp_replace(w, f"{_FROM}[^{_TO}]*{_TO}", "")
    inner = lambda w: F.when(F.contains(w, F.lit(_FROM)), F.array_join(F.regexp_extract_all(w, F.lit(f"{_FROM}([^{_TO}]*){_TO}"), 1), " ")).otherwise(w)
    each = F.transform(_reading(_marked(text, True), reading, True), lambda w: F.struct(kind(w).alias("kind"), F.btrim(inner(w), F.lit(MARKS)).alias("value")))

    def merged(x: Column) -> Column:
        leads = F.filter(F.transform(x, lambda s, i: F.when((s["kind"] != NAME) | ~F.coalesce(F.get(x, i - 1)["kind"] == NAME, F.lit(False)), i)), lambda i: i.isNotNull())

        def slot(at: Column) -> Column:
            ends = lambda k: F.coalesce(F.get(at, k + 1), F.size(x))
            value = lambda i, k: F.array_join(F.transform(F.slice(x, i + 1, ends(k) - i), lambda s: s["value"]), " ")
            return F.transform(at, lambda i, k: F.struct(F.get(x, i)["kind"].alias("kind"), value(i, k).alias("value")))

        return once(leads, slot)

    return once(each, merged)


def _paired(left: Column, right: Column, by: int) -> Column:
    """Hash of each element of ``left`` with that of ``right`` which is ``by`` places on; none beyond the end."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.slice(F.zip_with(left, F.slice(right, by + 1, n), lambda x, y: F.xxhash64(x, y)), 1, n)


def _windows(hashes: Column, widths: list[int], body) -> Column:
    """``body`` of the arrays of the hashes of all windows of each width (1 to 15), given by the hashes of their words.

    A window is put together of windows of 1, 2, 4 and 8 words, so that each word is looked at a few times only.
    """

    def rest(power: list[Column]) -> Column:
        size = 1 << len(power)
        if size <= max(widths):
            return once(_paired(power[-1], power[-1], size // 2), lambda p: rest([*power, p]))
        found = []
        for width in widths:
            have, done = None, 0
            for k in reversed(range(len(power))):
                if width >> k & 1:
                    have, done = (power[k] if have is None else _paired(have, power[k], done)), done + (1 << k)
            found.append(have)
        return body(found)

    return rest([hashes])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bare(text: Column) -> Column:
    """A whole text in lower case, with one blank for any blanks and marks between words."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?:{_BLANK}|{_M})++", " ")))


def _short_items(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Items that are too short for windows, where they are a document's whole text."""
    n = short.count()
    if not n:
        return short.select(F.lit(None).cast(docs.schema["key"].dataType).alias("key"), "item", *[F.lit(0).cast("long").alias(c) for c in FOUND]).where("false")
    asked = short.select("item", _bare(F.col("text")).alias("bare")).where("bare <> ''")
    found = docs.select("key", _bare(F.col("text")).alias("bare")).join(_sized(asked, n), "bare").select("key", "item").distinct()
    return found.select("key", "item", *[F.lit(k).cast("long").alias(c) for c, k in zip(FOUND, (1, 1, 0), strict=True)])


FOUND = ("n_found", "n_windows", "n_changed")


def _consistent(hits: DataFrame, items: DataFrame, docs: DataFrame, n_slots: int) -> tuple[DataFrame, DataFrame]:
    """Hits of the alignments whose placeholders map consistently, and how many of them changed, by (key, item, reading)."""
    one = ["key", "item", "reading"]
    slots = items.select("item", "reading", F.posexplode("slots").alias("place", "w")).where(F.col("w.kind").startswith("<")).select("item", "reading", "place", "w.kind", "w.value")
    seen = hits.join(_sized(slots, n_slots), ["item", "reading"]).where("place >= at and place < at + width")
    seen = seen.select(*one, "shift", "kind", "value", (F.col("shift") + F.col("place")).alias("pos")).distinct()
    # documents with hits alone are read again; their keys are broadcast, so that no text is shuffled
    keys = hits.select("key").distinct()
    wanted = docs.join(_sized(keys, keys.count()), "key").select("key", F.posexplode(F.array(*[_slots(F.col("text"), r) for r in READINGS])).alias("reading", "w"))
    wanted = wanted.select("key", "reading", F.posexplode("w").alias("pos", "w")).select("key", "reading", "pos", F.col("w.value").alias("other"))
    pairs = stored(seen.join(wanted, ["key", "reading", "pos"]).select(*one, "shift", "kind", "value", "other").distinct(), "pairs")
    # one value of the item to one of the document, and the other way round
    odd = [pairs.groupBy(*one, "shift", "kind", a).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*one, "shift") for a in ("value", "other")]
    odd = odd[0].unionByName(odd[1]).distinct()
    kept = hits.join(odd, [*one, "shift"], "left_anti")
    sizes = kept.groupBy(*one, "shift").agg(F.count_distinct("at").alias("n"))
    best = sizes.groupBy(*one).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("best"))
    # alignments that contradict the best one don't count with it
    of = pairs.join(best, one)
    chosen = of.where(F.col("shift") == F.col("best")).select(*one, "kind", "value", "other")
    against = of.join(chosen.withColumnRenamed("other", "_other"), [*one, "kind", "value"]).where(F.col("other") != F.col("_other"))
    kept = kept.join(against.select(*one, "shift").distinct(), [*one, "shift"], "left_anti")
    changed = chosen.groupBy(*one).agg(F.count_if(F.col("value") != F.col("other")).alias("n_changed"))
    return kept, changed


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item_key, n_found, n_windows, n_changed): the items that documents hold.

    ``n_found`` of the item's ``n_windows`` occur; ``n_changed`` values behind
    placeholders differ from the item's. The windows of the documents are never
    shuffled unless the benchmark has more than ``BROADCAST_ROWS`` windows.
    """
    readings, one = READINGS, ["key", "item", "reading"]
    texts = items.select(F.col(item_key).alias("item"), F.col(text).alias("text")).where("item is not null")
    items = texts.select("item", F.posexplode(F.array(*[_slots(F.col("text"), r) for r in readings])).alias("reading", "slots"))
    items = items.withColumn("width", F.least(F.size("slots"), F.lit(WIDTH))).withColumn("hashes", F.transform("slots", lambda x: F.xxhash64(x["kind"])))
    plain = F.transform(F.sequence(F.lit(0), F.size("slots") - F.col("width")), lambda i: F.exists(F.slice("slots", i + 1, F.col("width")), lambda x: ~x["kind"].startswith("<")))
    own = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for w in range(LEAST, WIDTH + 1):
        own = own.when(F.col("width") == w, _windows(F.col("hashes"), [w], lambda found: found[0]))
    asked = items.where(F.size("slots") >= LEAST).select("item", "reading", "width", plain.alias("plain"), F.posexplode(own).alias("at", "window"))
    asked = stored(asked.where(F.get("plain", F.col("at"))).drop("plain").distinct(), "asked")
    asked = asked.join(asked.groupBy("item", "reading").agg(F.count_distinct("at").alias("n_windows")), ["item", "reading"])
    n_asked, widths = asked.count(), sorted(r[0] for r in asked.select("width").distinct().collect())  # LEAST to WIDTH at most
    n_slots = items.agg(F.sum(F.size("slots"))).first()[0] or 0

    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    short = _short_items(docs, texts.join(asked.select("item").distinct(), "item", "left_anti"))
    widths = widths or [WIDTH]

    def every(h: Column, done: tuple[list[Column], ...] = ()) -> Column:
        if len(done) == len(readings):
            arrays = [x for found in done for x in found]
            ends, n = [], F.lit(0)
            for x in arrays:
                n = n + F.size(x)
                ends.append(n)
            return F.struct(F.array(*ends).alias("ends"), F.concat(*arrays).alias("windows"))
        return _windows(F.get(h, len(done)), widths, lambda found: once(F.array(*found), lambda a: every(h, (*done, [F.get(a, k) for k in range(len(found))]))))

    # generated, so that the texts are cut once, whatever is asked of the windows
    held = docs.select("key", F.explode(F.array(once(templates(F.col("text")), lambda h: every(h)))).alias("t")).select("key", "t.ends", F.posexplode("t.windows").alias("place", "window"))
    held = held.join(_sized(asked.select("window").distinct(), n_asked), "window").join(_sized(asked, n_asked), "window")
    # which reading's windows, and of what width, a place is in
    held = held.withColumn("which", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    held = held.where(F.col("which") == F.col("reading") * len(widths) + F.array_position(F.array(*map(F.lit, widths)), F.col("width")) - 1)
    held = held.withColumn("pos", F.col("place") - F.coalesce(F.get("ends", F.col("which") - 1), F.lit(0)))
    # read several times below; the texts are cut into windows once
    hits = stored(held.select(*one, "width", "n_windows", "pos", "at", (F.col("pos") - F.col("at")).alias("shift")), "hits")
    kept, changed = _consistent(hits, items, docs, n_slots)
    found = kept.groupBy(*one).agg(F.count_distinct("at").alias("n_found"), F.first("n_windows").alias("n_windows"))
    found = found.where((F.col("n_found") >= SHARE * F.col("n_windows")) | (F.col("n_found") >= ENOUGH)).join(changed, one, "left")
    # the reading of the largest share, of the most windows, the first
    best = F.max_by(F.struct(*FOUND), F.struct(F.col("n_found") / F.col("n_windows"), "n_found", -F.col("reading")))
    found = found.groupBy("key", "item").agg(best.alias("b")).select("key", "item", *[F.coalesce(f"b.{c}", F.lit(0)).cast("long").alias(c) for c in FOUND])
    return found.unionByName(short).select(F.col("key").alias(key), F.col("item").alias(item_key), *FOUND)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, one row for each item held."""
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
