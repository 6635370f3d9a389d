"""Operators on cues: rows (track_id, cue_idx, start_s, end_s, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.functions.language import BOOST, CONTRADICTION, LEAST_WORDS, PROFILES, SIGNATURES, normalized, script
from cuewright.functions.text import CUE_CHARS, clean_line, collapsed, ends_sentence, once, plain_words, stamp, words, wrapped
from cuewright.operators import sequences
from cuewright.scratch import kept

#: Seconds: longest and shortest cue, and the gap over which segments are joined.
LONGEST, SHORTEST, JOIN_GAP = 7.0, 1.0, 0.35


def cleaned(cues: DataFrame) -> DataFrame:
    """Cues with ``clean``; those without speech go, and those that repeat the line before them."""
    kept = cues.withColumn("clean", clean_line(F.col("text"))).where("clean <> ''")
    before = F.lag(F.lower("clean")).over(Window.partitionBy("track_id").orderBy("cue_idx"))
    return kept.withColumn("_before", before).where("_before is null or _before <> lower(clean)").drop("_before")


def timed_tokens(cues: DataFrame, text: str = "text") -> DataFrame:
    """Each word of each cue with its time: word i of n at start + length * (i + 0.5) / n."""
    listed = cues.withColumn("_words", words(F.col(text)))
    rows = listed.select("*", F.posexplode("_words").alias("i", "word"))
    length = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    return rows.withColumn("at_s", F.col("start_s") + length * ((F.col("i") + 0.5) / F.size("_words"))).drop("_words")


def language_scores(docs: DataFrame, key: str, text: str = "text", profiles: dict[str, list[str]] | None = None, signatures: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, code, score) of every guess above zero: hits of a language's function words over all words, boosted by its letters.

    Texts of a script of its own have one guess; of the others, those of fewer
    than 40 words have none. A text is read once; only words that are in a
    profile go on to the count, which is combined before it is shuffled.
    """
    profiles, signatures = profiles or PROFILES, signatures or SIGNATURES
    known = [(code, w[0]) for code, listed in profiles.items() for marker in listed if len(w := plain_words(marker)) == 1]
    table = docs.sparkSession.createDataFrame(known or [("", "")], "code string, word string")
    markers = sorted({w for _, w in known})
    # characters beyond ASCII, and the letters within it that count, each once; then the languages that have one of them
    ascii_letters = "".join(sorted({x for letters in signatures.values() for x in letters if x.isascii()}))
    plain = f"[\\x00-\\x7F&&[^{ascii_letters}]]+" if ascii_letters else "[\\x00-\\x7F]+"
    seen = F.array_join(F.array_distinct(F.split(F.regexp_replace(F.lower(F.col(text)), plain, ""), "")), "")
    boosted = once(seen, lambda x: F.concat_ws(",", *[F.when(x.rlike("[" + "".join(letters) + "]"), code) for code, letters in signatures.items() if code in profiles]))

    def told(listed: Column) -> Column:
        return F.struct(F.size(listed).alias("n"), F.filter(listed, lambda w: w.isin(markers)).alias("words"))

    one = F.struct(script(F.col(text)).alias("script"), once(words(F.col(text)), told).alias("told"), boosted.alias("boosted"))
    # generated, so that what follows mentions columns and not the expressions again
    base = docs.select(key, F.explode(F.array(one)).alias("t")).select(key, "t.script", "t.told", "t.boosted")
    spoken = F.col("script").isNull() & (F.col("told.n") >= LEAST_WORDS)
    rows = base.where(spoken | F.col("script").isNotNull()).select(key, "script", "boosted", F.col("told.n").alias("n"), F.explode_outer(F.when(spoken, F.col("told.words"))).alias("word"))
    hits = rows.join(F.broadcast(table), "word", "left").select(key, "script", "boosted", "n", F.coalesce("script", "code").alias("code")).where("code is not null")
    # what is the same for all of a text's words is a key, so that only a number is added up
    counted = hits.groupBy(key, "code", "script", "boosted", "n").agg(F.count(F.lit(1)).alias("hits"))
    score = F.col("hits") / F.col("n") * F.when(F.find_in_set(F.col("code"), F.col("boosted")) > 0, BOOST).otherwise(1.0)
    return counted.select(key, "code", F.when(F.col("script").isNotNull(), 1.0).otherwise(score).alias("score"))


def top_guesses(scores: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The best guesses, by score and then code, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "code")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 1))


def contradictions(docs: DataFrame, scores: DataFrame, key: str, tag: str, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, tag, top_code, top_score, contradicted): whether the best guess leads the tagged language by 2.5 times."""
    best = top_guesses(scores, key, 5)
    tagged = docs.select(key, F.col(tag).alias("tag"), normalized(F.col(tag)).alias("_code"))
    joined = tagged.join(best, key, "left")
    found = joined.groupBy(key, "tag", "_code").agg(
        F.max(F.when(F.col("rank") == 1, F.col("code"))).alias("top_code"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.coalesce(F.max(F.when(F.col("code") == F.col("_code"), F.col("score"))), F.lit(0.0)).alias("_own"),
    )
    known = F.col("_code").isin(list(profiles or PROFILES))
    leads = F.col("top_code").isNotNull() & (F.col("_code") != "") & known & (F.col("top_code") != F.col("_code")) & (F.col("top_score") >= CONTRADICTION * F.col("_own"))
    return found.select(key, "tag", "top_code", "top_score", F.coalesce(leads, F.lit(False)).alias("contradicted"))


def retimed(cues: DataFrame, offset: Column, scale: Column) -> DataFrame:
    """Cues moved to the audio's clock: (t - offset) / scale; a scale that is no positive number counts as 1."""
    by = F.when((scale > 0) & (scale < float("inf")), scale).otherwise(1.0)
    return cues.withColumns({"start_s": (F.col("start_s") - offset) / by, "end_s": (F.col("end_s") - offset) / by})


def joined_segments(segments: DataFrame, chunk: int = sequences.CHUNK) -> DataFrame:
    """Segments that were cut within an utterance joined again, as (track_id, seg_idx, start_s, end_s, text).

    A segment joins those before it unless a pause or the end of a sentence lies
    between, or they would be too long together, in characters or seconds. So
    where a joined segment stops is told by where it began: each row points to
    the one that would begin the next, at most half a cue's characters away, and
    the beginnings are the rows that pointers lead to from the first ones.
    """
    rows = segments.select("track_id", "start_s", "cue_idx", "end_s", collapsed(F.col("text")).alias("text")).where("text <> ''")
    listed = kept(sequences.numbered(rows, "track_id", ["start_s", "cue_idx", "end_s", "text"]), "segments")
    most = CUE_CHARS // 2  # each has a character, and a blank before it
    steps = listed.select("track_id", "idx", "start_s", "end_s", F.length("text").alias("chars"), ends_sentence(F.col("text")).alias("closed"))
    part = Window.partitionBy("track_id", "chunk").orderBy("idx")
    steps = sequences.dealt(steps, 1, most, chunk=chunk)
    last = F.lag(F.struct("end_s", "closed")).over(part)
    steps = steps.withColumns({"_last": last, "upto": F.sum(F.col("chars") + 1).over(part)})
    steps = steps.withColumn("apart", F.col("_last").isNull() | (F.col("start_s") - F.col("_last.end_s") > JOIN_GAP) | F.col("_last.closed"))
    following = F.collect_list(F.struct("idx", "apart", "end_s", "upto")).over(part.rowsBetween(1, most))
    stops = lambda x: x["apart"] | (x["end_s"] - F.col("start_s") > LONGEST) | (x["upto"] - F.col("upto") + F.col("chars") > CUE_CHARS)
    told = steps.withColumn("stop", F.get(F.filter(following, stops), F.lit(0))).where("own")
    told = kept(told.select("track_id", "idx", "apart", F.when(~F.col("stop.apart"), F.col("stop.idx")).alias("to")), "stops")
    heads = sequences.orbits(told.where("apart"), told.where("to is not null"), "track_id")
    marks = heads.select("track_id", "idx", F.lit(True).alias("begins"))
    joined = sequences.nearest(sequences.followed(listed, "idx", marks, "track_id", how="left"), "track_id", F.col("begins"), most, chunk=chunk)
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))["text"]
    done = joined.groupBy("track_id", "head").agg(F.min_by("start_s", "idx").alias("start_s"), F.max_by("end_s", "idx").alias("end_s"), F.array_join(parts, " ").alias("text"))
    return sequences.counted(done, "track_id", "head", "seg_idx", chunk).select("track_id", "seg_idx", "start_s", "end_s", "text")


def text_pieces(text: Column) -> Column:
    """A long line in pieces: cut at sentence ends, at commas beyond half a cue, and at a cue's length."""
    parts = F.filter(F.split(text, " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, w: Column) -> Column:
        line = F.when(a["open"] == "", w).otherwise(F.concat(a["open"], F.lit(" "), w))
        full = (F.length(line) >= CUE_CHARS) | ends_sentence(w) | (w.endswith(",") & (F.length(line) > CUE_CHARS // 2))
        return F.struct(F.when(full, F.concat(a["done"], F.array(line))).otherwise(a["done"]).alias("done"), F.when(full, "").otherwise(line).alias("open"))

    return F.aggregate(parts, start, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def split_segments(segments: DataFrame) -> DataFrame:
    """Segments too long for one cue in pieces that share its time by their characters, each wrapped; (track_id, seg_idx, piece_idx, ...)."""
    whole = (F.length("text") <= CUE_CHARS) & (F.col("end_s") - F.col("start_s") <= LONGEST)
    rows = segments.withColumn("_pieces", F.when(whole, F.array("text")).otherwise(text_pieces(F.col("text"))))
    total = F.aggregate("_pieces", F.lit(0), lambda n, p: n + F.length(p))
    rows = rows.withColumn("_total", total).where("_total > 0").select("*", F.posexplode("_pieces").alias("piece_idx", "piece"))
    before = F.aggregate(F.slice("_pieces", 1, F.col("piece_idx")), F.lit(0), lambda n, p: n + F.length(p))
    length = F.col("end_s") - F.col("start_s")
    rows = rows.withColumns({"_from": F.col("start_s") + length * before / F.col("_total"), "_to": F.col("start_s") + length * (before + F.length("piece")) / F.col("_total")})
    return rows.select("track_id", "seg_idx", "piece_idx", F.col("_from").alias("start_s"), F.col("_to").alias("end_s"), wrapped(F.col("piece")).alias("text"))


def tidied(cues: DataFrame) -> DataFrame:
    """Cues in order, from 1 to 7 seconds long and not before zero, each cut where the next starts; empty ones go."""
    rows = cues.where(F.trim("text") != "").withColumn("start_s", F.greatest("start_s", F.lit(0.0)))
    length = F.least(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(SHORTEST)), F.lit(LONGEST))
    following = F.lead("start_s").over(Window.partitionBy("track_id").orderBy("start_s", "cue_idx"))
    rows = rows.withColumn("end_s", F.least(F.col("start_s") + length, following))
    return rows.where("end_s > start_s")


def transcript_cues(segments: DataFrame) -> DataFrame:
    """Cues of a transcript: joined, split, tidied, as (track_id, cue_idx, start_s, end_s, text)."""
    parts = split_segments(joined_segments(segments))
    order = Window.partitionBy("track_id").orderBy("seg_idx", "piece_idx")
    done = tidied(parts.withColumn("cue_idx", F.row_number().over(order) - 1))
    return done.select("track_id", "cue_idx", "start_s", "end_s", "text")


def anchor_windows(cues: DataFrame, runtime_s: Column, count: int = 5, window_s: float = 30.0, head: float = 5, tail: float = 8, step_s: float = 5.0) -> DataFrame:
    """(track_id, anchor_idx, start_s, duration_s, expected_words): windows spread over each track where most different words are spoken.

    ``runtime_s`` is a column of ``cues``; where it is not positive the last
    cue's end stands in. A cue's candidate windows follow from its times and the
    plan of its track, so candidates without words are never rows, and what is
    joined has a row a track or an anchor.
    """
    trims = [min(max(x, 0), 45) / 100 for x in (head, tail)]
    plan = cues.groupBy("track_id").agg(F.max(runtime_s).alias("r"), F.max_by("end_s", F.struct("start_s", "cue_idx")).alias("last"))
    plan = plan.withColumn("total", F.when(F.col("r") > 0, F.col("r")).otherwise(F.col("last"))).where("total > 0")
    plan = plan.withColumns({"lo": F.col("total") * trims[0], "hi": F.col("total") - F.col("total") * trims[1]})
    short = F.col("hi") - F.col("lo") < window_s
    plan = plan.withColumns({"lo": F.when(short, 0.0).otherwise(F.col("lo")), "hi": F.when(short, F.col("total")).otherwise(F.col("hi"))})
    tiny = F.col("hi") - F.col("lo") < window_s
    plan = plan.withColumns({"len": F.when(tiny, F.col("hi") - F.col("lo")).otherwise(window_s), "n": F.when(tiny, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(count), F.floor((F.col("hi") - F.col("lo")) / window_s)).cast("int")))})
    plan = plan.withColumn("slot", (F.col("hi") - F.col("lo")) / F.col("n"))
    plan = plan.withColumn("steps", F.greatest(F.floor((F.col("slot") - F.col("len") + 1e-9) / step_s), F.lit(0)))
    at = lambda i, k: F.col("lo") + F.col("slot") * i + k * step_s
    every = F.sequence(F.lit(0), F.col("n") - 1)
    heard = cues.select("track_id", F.col("start_s").alias("from_s"), F.greatest("start_s", "end_s").alias("to_s"), F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) >= 2)).alias("words"))
    heard = heard.join(plan.select("track_id", "lo", "len", "n", "slot", "steps"), "track_id").where("from_s is not null and to_s is not null")
    # of each anchor, the steps whose windows may overlap the cue, one more at either side, as times are rounded
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.col("steps"))
    low = inside(F.floor((F.col("from_s") - F.col("len") - at(F.col("anchor_idx"), F.lit(0))) / step_s) - 1)
    high = inside(F.ceil((F.col("to_s") - at(F.col("anchor_idx"), F.lit(0))) / step_s) + 1)
    tries = heard.withColumn("anchor_idx", F.explode(every)).withColumn("k", F.explode(F.sequence(low, high))).withColumn("start_s", at(F.col("anchor_idx"), F.col("k")))
    met = tries.where("to_s >= start_s and from_s <= start_s + len").select("track_id", "anchor_idx", "k", F.explode("words").alias("word"))
    scores = met.groupBy("track_id", "anchor_idx", "k").agg(F.count_distinct("word").alias("words"))
    best = scores.groupBy("track_id", "anchor_idx").agg(F.max(F.struct("words", (-F.col("k")).alias("k"))).alias("best"))
    # where no candidate has a word, the first one stands
    done = plan.withColumn("anchor_idx", F.explode(every)).join(best, ["track_id", "anchor_idx"], "left")
    start = F.least(at(F.col("anchor_idx"), F.coalesce(-F.col("best.k"), F.lit(0))), F.col("hi") - F.col("len"))
    return done.select("track_id", "anchor_idx", start.alias("start_s"), F.col("len").alias("duration_s"), F.coalesce("best.words", F.lit(0)).alias("expected_words"))


def srt_text(cues: DataFrame) -> DataFrame:
    """(track_id, srt): each track as one SubRip text with CRLF line ends, numbered from 1 in order of start and then cue_idx."""
    listed = cues.select("track_id", F.struct(F.greatest("start_s", F.lit(0.0)).alias("s"), "cue_idx", F.greatest("start_s", "end_s", F.lit(0.0)).alias("e"), "text").alias("c"))
    order = Window.partitionBy("track_id").orderBy("c.s", "c.cue_idx")
    lines = F.regexp_replace("c.text", "\r?\n", "\r\n")
    block = F.concat(F.row_number().over(order).cast("string"), F.lit("\r\n"), stamp(F.col("c.s")), F.lit(" --> "), stamp(F.col("c.e")), F.lit("\r\n"), lines, F.lit("\r\n"))
    blocks = listed.withColumn("block", block).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("c.s", "c.cue_idx", "block"))).alias("b"))
    return blocks.select("track_id", F.array_join("b.block", "\r\n").alias("srt"))

