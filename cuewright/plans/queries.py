"""The named queries: (function of the session and the tables' folder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuewright.functions import commands, language, naming, text
from cuewright.operators import alignment, cues as cue_ops, intervals, library, repairs, reports, signals, sync
from cuewright.plans import derived, sql
from cuewright.plans.derived import table
from cuewright.scratch import kept, work_dir
from cuewright.settings import Settings, language_list
from cuewright.sources import files, inventory, providers, runs, silences, srt, store, transcripts
from cuewright.streaming import recheck

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
RUNTIME = 5400.0
LANGUAGES = ["en", "fr", "it"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, oracle)
        return f

    return add


def r6(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# text


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('text')}) AS word FROM documents) GROUP BY word")
def tok_words(spark, d):
    return table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.D1} SELECT track_id, cue_idx, CAST(i AS INTEGER) AS i, w[i + 1] AS word, round(start_s + 1.5 * ((i + 0.5) / len(w)), 6) AS at_s FROM (SELECT *, unnest(range(len(w))) AS i FROM (SELECT *, {sql.words('text')} AS w FROM d1))")
def tok_spread(spark, d):
    return cue_ops.timed_tokens(derived.cues(spark, d)).select("track_id", "cue_idx", "i", "word", r6("at_s"))


@query(f"WITH {sql.D1} SELECT track_id, count(DISTINCT word) AS n FROM (SELECT track_id, unnest({sql.words('text')}) AS word FROM d1) WHERE length(word) >= 2 GROUP BY track_id")
def tok_distinct_words(spark, d):
    rows = derived.cues(spark, d).select("track_id", F.explode(text.words(F.col("text"))).alias("word"))
    return rows.where(F.length("word") >= 2).groupBy("track_id").agg(F.count_distinct("word").alias("n"))


@query(f"WITH {sql.D1} SELECT track_id, cue_idx, {sql.clean('text')} AS clean FROM d1")
def clean_line(spark, d):
    return derived.cues(spark, d).select("track_id", "cue_idx", text.clean_line(F.col("text")).alias("clean"))


@query(f"WITH {sql.D1}, c AS (SELECT track_id, cue_idx, {sql.clean('text')} AS clean FROM d1), k AS (SELECT *, lag(lower(clean)) OVER (PARTITION BY track_id ORDER BY cue_idx) AS b FROM c WHERE clean <> '') SELECT track_id, cue_idx, clean FROM k WHERE b IS NULL OR b <> lower(clean)")
def clean_dedupe(spark, d):
    return cue_ops.cleaned(derived.cues(spark, d)).select("track_id", "cue_idx", "clean")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


_CREDIT = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND n % 3 = 0 THEN 'Subtitles by ' || source WHEN doc_id % 9 = 1 THEN 'see WWW.' || lang || '.example' WHEN doc_id % 9 = 2 THEN 'www without a point, corrected  by' ELSE line END AS line FROM (SELECT doc_id, source, lang, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


@query(f"SELECT doc_id, count(*) AS n FROM ({_CREDIT}) WHERE {sql.credits('line')} GROUP BY doc_id")
def credits_filter(spark, d):
    """Lines of the documents, some of them replaced by credits."""
    lines = table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    on = lambda r: F.col("doc_id") % 9 == r
    line = F.when(on(0) & (F.col("n") % 3 == 2), F.concat(F.lit("Subtitles by "), "source")).when(on(1), F.concat(F.lit("see WWW."), "lang", F.lit(".example"))).when(on(2), "www without a point, corrected  by").otherwise(F.col("line"))
    return lines.where(text.is_credits(line)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, count(*) AS short_lines, count(*) FILTER ({sql.music('line')}) AS n FROM ({_LINES}) WHERE length(line) <= 40 GROUP BY doc_id")
def music_filter(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") <= 40)
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("short_lines"), F.count_if(text.is_music(F.col("line"))).alias("n"))


# language


@query(f"SELECT doc_id, {sql.script('text')} AS code FROM {sql.TEXTS}")
def lang_script(spark, d):
    return derived.texts(spark, d).select("doc_id", language.script(F.col("text")).alias("code"))


def _scores(spark, d):
    return cue_ops.language_scores(derived.texts(spark, d), "doc_id")


@query(f"WITH {sql.IDENT} SELECT doc_id, code, round(score, 6) AS score FROM ranked WHERE rank = 1")
def lang_identify(spark, d):
    return cue_ops.top_guesses(_scores(spark, d), "doc_id", 1).select("doc_id", "code", r6("score"))


@query(f"WITH {sql.IDENT} SELECT doc_id, CAST(rank AS INTEGER) AS rank, code, round(score, 6) AS score FROM ranked WHERE rank <= 3")
def lang_top3(spark, d):
    return cue_ops.top_guesses(_scores(spark, d), "doc_id", 3).select("doc_id", "rank", "code", r6("score"))


def _contradicted(spark, d):
    docs = derived.texts(spark, d)
    return cue_ops.contradictions(docs, cue_ops.language_scores(docs, "doc_id"), "doc_id", "lang")


@query(f"WITH {sql.IDENT}, {sql.CONTRA} SELECT doc_id, tag, top_code, round(top_score, 6) AS top_score, contradicted FROM judged")
def lang_contradicts(spark, d):
    return _contradicted(spark, d).select("doc_id", "tag", "top_code", r6("top_score"), "contradicted")


@query(f"WITH {sql.IDENT}, {sql.CONTRA} SELECT tag, coalesce(top_code, 'none') AS top_code, count(*) AS n, count(*) FILTER (contradicted) AS contradicted FROM judged GROUP BY ALL")
def lang_summary(spark, d):
    rows = _contradicted(spark, d).withColumn("top_code", F.coalesce("top_code", F.lit("none")))
    return rows.groupBy("tag", "top_code").agg(F.count(F.lit(1)).alias("n"), F.count_if("contradicted").alias("contradicted"))


_TAGS = ["en", "ENG", "pt-BR", "zh_Hans", "French", "  deu ", "xx", "klingon", "", "spanish", "-x"]
_TAG_SQL = f"(SELECT DISTINCT tag FROM (SELECT lang AS tag FROM documents UNION ALL SELECT unnest([{', '.join(map(sql.q, _TAGS))}])))"


def _tags(spark, d):
    rows = spark.createDataFrame([(t,) for t in _TAGS], "tag string")
    return table(spark, d, "documents").select(F.col("lang").alias("tag")).unionByName(rows).distinct()


@query(f"SELECT tag, {sql.normalized('tag')} AS code FROM {_TAG_SQL}")
def code_normalize(spark, d):
    return _tags(spark, d).select("tag", language.normalized(F.col("tag")).alias("code"))


@query(f"SELECT tag, CASE WHEN code = '' THEN 'untagged' ELSE coalesce(MAP {{{', '.join(f'{sql.q(a)}: {sql.q(b)}' for a, b in language.NAMES.items())}}}[code], code) END AS name FROM (SELECT tag, {sql.normalized('tag')} AS code FROM {_TAG_SQL})")
def code_name(spark, d):
    return _tags(spark, d).select("tag", language.language_name(F.col("tag")).alias("name"))


# subtitle files


@query(f"WITH {sql.D1} SELECT track_id, cue_idx, {sql.stamp('start_s + cue_idx / 7e0')} AS stamp FROM d1")
def srt_stamp(spark, d):
    return derived.cues(spark, d).select("track_id", "cue_idx", text.stamp(F.col("start_s") + F.col("cue_idx") / 7.0).alias("stamp"))


@query(f"WITH {sql.D1}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, cue_idx) AS k FROM d1) SELECT track_id, string_agg(k || chr(13) || chr(10) || {sql.stamp('start_s')} || ' --> ' || {sql.stamp('end_s')} || chr(13) || chr(10) || regexp_replace(text, '\\r?\\n', chr(13) || chr(10), 'g') || chr(13) || chr(10), chr(13) || chr(10) ORDER BY k) AS srt FROM n GROUP BY track_id")
def srt_write(spark, d):
    return cue_ops.srt_text(derived.cues(spark, d))


def _flat(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '\\r\\n|\\r|\\n'), lambda l: trim(l)), lambda l: l <> ''), ' ')"


# what a track says up to its first blank line, in one line
_FIRST = "string_split_regex(text, '\\n\\s*\\n')[1]"


@query(f"WITH {sql.D1} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) - 1 AS INTEGER) AS cue_idx, start_s, end_s, {_flat('text')} AS text FROM d1")
def srt_parse(spark, d):
    rows = derived.cues(spark, d).withColumn("text", F.regexp_replace("text", r"\n\s*\n", "\n"))
    return srt.parsed(cue_ops.srt_text(rows), content="srt").select("track_id", "cue_idx", r6("start_s", 3), r6("end_s", 3), "text")


@query(f"WITH {sql.D1} SELECT track_id, count(*) AS cues, count(*) AS same FROM d1 GROUP BY track_id")
def srt_roundtrip(spark, d):
    rows = derived.cues(spark, d).withColumn("text", text.collapsed(F.col("text")))
    back = srt.parsed(cue_ops.srt_text(rows), content="srt").select("track_id", "cue_idx", F.col("text").alias("t"), F.col("start_s").alias("s"))
    same = (F.col("text") == F.col("t")) & (F.abs(F.col("start_s") - F.col("s")) < 0.001)
    return rows.join(back, ["track_id", "cue_idx"]).groupBy("track_id").agg(F.count(F.lit(1)).alias("cues"), F.count_if(same).alias("same"))


# silences and signals

_DAY = 4400.0


@query(f"""WITH {sql.D2}, s AS (SELECT item_id, start_s, end_s, max(end_s) OVER (PARTITION BY item_id ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d2),
  m AS (SELECT *, sum(CASE WHEN b IS NULL OR start_s > b THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY start_s, end_s) AS g FROM s),
  q AS (SELECT item_id, g, round(min(start_s), 3) AS s, round(max(end_s), 3) AS e FROM m GROUP BY ALL), x AS (SELECT item_id, s, least(e, {_DAY}) AS e FROM q UNION ALL SELECT DISTINCT item_id, {_DAY}, {_DAY} FROM q),
  y AS (SELECT item_id, s, coalesce(max(e) OVER (PARTITION BY item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM x)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY f) - 1 AS INTEGER) AS span_idx, f AS start_s, s AS end_s FROM y WHERE s > f""")
def silence_to_speech(spark, d):
    """The spans of speech as if they were silences, written as a log and read again."""
    spans = derived.speech(spark, d)
    before = F.max("end_s").over(Window.partitionBy("item_id").orderBy("start_s", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("b", before).withColumn("new", (F.col("b").isNull() | (F.col("start_s") > F.col("b"))).cast("int"))
    marked = marked.withColumn("g", F.sum("new").over(Window.partitionBy("item_id").orderBy("start_s", "end_s")))
    quiet = marked.groupBy("item_id", "g").agg(F.min("start_s").alias("s"), F.max("end_s").alias("e"))
    line = F.concat(F.lit("[silencedetect] silence_start: "), F.format_string("%.3f", F.round("s", 3)), F.lit("\n[silencedetect] silence_end: "), F.format_string("%.3f", F.round("e", 3)), F.lit(" | silence_duration: 1"))
    logs = quiet.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("s", line.alias("l"))))["l"], "\n").alias("log")).withColumn("duration_s", F.lit(_DAY))
    return silences.speech(logs)


@query(f"WITH {sql.D2} SELECT item_id, bin FROM {sql.bins('d2', '0.2e0')}")
def bins_speech(spark, d):
    return signals.marked(derived.speech(spark, d), ["item_id"], signals.COARSE)


_PAL = 23.976 / 25


@query(f"WITH {sql.D2}, {sql.d3(0.0, _PAL)} SELECT item_id, bin FROM {sql.bins('d3', '0.2e0', f'start_s / {_PAL!r}', f'end_s / {_PAL!r}')}")
def bins_cues_scaled(spark, d):
    return signals.marked(derived.film_cues(derived.speech(spark, d), 0.0, _PAL), ["item_id"], signals.COARSE, scale=_PAL)


@query(f"WITH {sql.D2} SELECT item_id, count(*) AS active, min(bin) AS first_active, max(bin) AS last_active, round(count(*) / (max(bin) - min(bin) + 1), 6) AS content_coverage FROM {sql.bins('d2', '0.2e0')} GROUP BY item_id")
def content_coverage(spark, d):
    return signals.coverage(bins_speech(spark, d), ["item_id"]).withColumn("content_coverage", F.round("content_coverage", 6))


def _signals(spark, d):
    spans = derived.speech(spark, d)
    audio, film = signals.marked(spans, ["item_id"], signals.COARSE), signals.marked(derived.film_cues(spans, 9.0, 1.0), ["item_id"], signals.COARSE)
    return audio, film


def _curve(spark, d):
    return signals.summed_curve(*_signals(spark, d), ["item_id"], 75)


@query(f"WITH {sql.D2}, {sql.d3(9.0, 1.0)}, {sql.CURVE.replace('75', '50').replace('76', '51')} SELECT item_id, lag, round(score, 6) AS score FROM curve")
def xcorr_pairs(spark, d):
    """The same curve over a shorter span, by pairs of runs instead of transforms."""
    spans = derived.speech(spark, d)
    audio, film = (signals.marked_runs(x, ["item_id"], signals.COARSE) for x in (spans, derived.film_cues(spans, 9.0, 1.0)))
    return signals.runs_curve(audio, film, ["item_id"], 50).select("item_id", "lag", r6("score"))


@query(f"WITH {sql.D2}, {sql.d3(9.0, 1.0)}, {sql.CURVE} SELECT item_id, lag, round(score, 6) AS score FROM curve")
def xcorr_coarse(spark, d):
    return _curve(spark, d).select("item_id", "lag", r6("score"))


@query(f"WITH {sql.D2}, {sql.d3(9.0, 1.0)}, {sql.CURVE} SELECT item_id, peak AS lag, round(top, 6) AS score, round(least(greatest((top - 0.15) / 0.40, 0), 1), 6) AS strength FROM best")
def xcorr_peak(spark, d):
    return signals.peaks(_curve(spark, d), ["item_id"]).select("item_id", "lag", r6("score"), F.round(signals.match_strength(F.col("score")), 6).alias("strength"))


@query(f"WITH {sql.D2}, {sql.d3(9.0, 1.0)}, {sql.CURVE} SELECT item_id, round((any_value(top) - avg(score)) / stddev_pop(score), 4) AS prominence FROM curve JOIN best USING (item_id) WHERE abs(lag - peak) > 3 GROUP BY item_id")
def xcorr_prominence(spark, d):
    return signals.peaks(_curve(spark, d), ["item_id"]).select("item_id", r6("prominence", 4))


FILMS = [("late", 9.0, 1.0), ("pal", 0.0, _PAL), ("slow", 6.0, 25 / 24)]


def _aligned(spark, d):
    spans = derived.speech(spark, d)
    film = None
    for name, offset, scale in FILMS:
        one = derived.film_cues(spans, offset, scale).withColumn("track", F.lit(name))
        film = one if film is None else film.unionByName(one)
    return alignment.aligned(spans, film, "item_id", "track")


@query()
def vad_global(spark, d):
    return _aligned(spark, d).select("item_id", "track", "failure", r6("score"), r6("offset_s"), r6("scale", 9))


@query()
def vad_windows(spark, d):
    rows = _aligned(spark, d).select("item_id", "track", F.posexplode("anchors").alias("anchor_idx", "a"))
    return rows.select("item_id", "track", "anchor_idx", F.round("a.at_s", 6).alias("at_s"), F.round("a.offset_s", 6).alias("offset_s"), F.round("a.confidence", 6).alias("confidence"))


@query()
def vad_verdict(spark, d):
    """Verdicts of all tracks; one whose measurement failed or matched nowhere has no fit."""
    key = F.concat_ws("/", F.col("item_id").cast("string"), "track").alias("case_key")
    measured = kept(_aligned(spark, d).withColumn("case_key", key), "verdicts")
    points = measured.select("case_key", F.explode("anchors").alias("a")).select("case_key", "a.at_s", "a.offset_s", "a.confidence")
    fits = sync.assessed(points, sync.drift_fit(points, "case_key"), "case_key", RUNTIME)
    said = library.judged_signal(measured, fits, "case_key")
    done = fits.withColumn("repair", sync.should_repair()).select("case_key", "confident", "offset_s", "scale", "frame_rate", "worst_s", "repair")
    return said.join(done, "case_key", "left").select("case_key", "verdict", "confident", r6("offset_s", 3), r6("scale", 6), "frame_rate", r6("worst_s", 3), F.coalesce("repair", F.lit(False)).alias("repair"))


@query("SELECT doc_id AS case_key, CASE WHEN doc_id % 5 = 0 THEN 'Unknown' WHEN doc_id % 100 < 25 THEN 'Mismatched' WHEN doc_id % 3 = 0 THEN 'Unknown' WHEN doc_id % 7 = 0 THEN 'Unknown' ELSE ['InSync', 'Offset', 'Drifting', 'Mismatched'][doc_id % 4 + 1] END AS verdict FROM documents")
def judged_signal(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_key"))
    none = F.array().cast("array<int>")
    measured = docs.select("case_key", F.when(F.col("case_key") % 5 == 0, "failed").alias("failure"), (F.col("case_key") % 100 / 100.0).alias("score"), F.when(F.col("case_key") % 3 == 0, none).otherwise(F.array(F.lit(1))).alias("anchors"))
    fits = docs.where("case_key % 7 <> 0").select("case_key", F.element_at(F.array(*[F.lit(v) for v in ("InSync", "Offset", "Drifting", "Mismatched")]), (F.col("case_key") % 4 + 1).cast("int")).alias("verdict"))
    return library.judged_signal(measured, fits, "case_key")


# offset votes


def _votes(spark, d):
    tokens = cue_ops.timed_tokens(derived.cues(spark, d)).select("track_id", "word", "at_s")
    return sync.offset_histogram(tokens, tokens.withColumn("at_s", F.col("at_s") - 2.5), "track_id", 30.0)


@query(f"WITH {sql.D1}, {sql.VOTE} SELECT track_id, bin, round(weight, 6) AS weight, votes FROM hist")
def offset_histogram(spark, d):
    return _votes(spark, d).select("track_id", "bin", r6("weight"), "votes")


@query(f"WITH {sql.D1}, {sql.VOTE} SELECT track_id, bin, round(smooth, 6) AS smooth FROM smooth")
def offset_smoothed(spark, d):
    return sync.smoothed(_votes(spark, d), "track_id").select("track_id", "bin", r6("smooth"))


@query(f"WITH {sql.D1}, {sql.VOTE}, {sql.PEAK} SELECT track_id, round(peak * 0.2e0, 6) AS offset_s, round(greatest(0, least(1, agree / total * (1 - coalesce(rh, 0) / height))), 6) AS confidence, CAST(votes AS BIGINT) AS votes, round(rival * 0.2e0, 6) AS runner_up_s FROM mass LEFT JOIN rival USING (track_id)")
def offset_measure(spark, d):
    return sync.measured_offset(_votes(spark, d), "track_id").select("track_id", r6("offset_s"), r6("confidence"), "votes", r6("runner_up_s"))


@query(f"""WITH {sql.D1}, p AS (SELECT track_id, max_by(end_s, cue_idx) AS total FROM d1 GROUP BY track_id), r AS (SELECT *, total * 0.05e0 AS lo, total - total * 0.08e0 AS hi FROM p),
  n AS (SELECT *, greatest(1, least(5, CAST(floor((hi - lo) / 30) AS INTEGER))) AS n FROM r), s AS (SELECT *, (hi - lo) / n AS slot, unnest(range(n)) AS anchor_idx FROM n),
  t AS (SELECT *, lo + slot * anchor_idx + k * 5e0 AS start_s FROM (SELECT *, unnest(range(CAST(greatest(floor((slot - 30 + 1e-9) / 5), 0) AS INTEGER) + 1)) AS k FROM s)),
  w AS (SELECT track_id, start_s AS a, end_s AS b, unnest({sql.words('text')}) AS word FROM d1), x AS (SELECT t.track_id, anchor_idx, k, count(DISTINCT word) AS n FROM t JOIN w ON t.track_id = w.track_id AND b >= t.start_s AND a <= t.start_s + 30 AND length(word) >= 2 GROUP BY ALL),
  z AS (SELECT t.*, coalesce(x.n, 0) AS e, row_number() OVER (PARTITION BY t.track_id, t.anchor_idx ORDER BY coalesce(x.n, 0) DESC, t.k) AS q FROM t LEFT JOIN x ON x.track_id = t.track_id AND x.anchor_idx = t.anchor_idx AND x.k = t.k)
  SELECT track_id, CAST(anchor_idx AS INTEGER) AS anchor_idx, round(least(start_s, hi - 30), 6) AS start_s, 30e0 AS duration_s, e AS expected_words FROM z WHERE q = 1""")
def anchor_plan(spark, d):
    return cue_ops.anchor_windows(derived.cues(spark, d), F.lit(0.0)).select("track_id", "anchor_idx", r6("start_s"), "duration_s", "expected_words")


@query(f"WITH {sql.D2}, {sql.d3(9.0, 1.0)} SELECT a.item_id, count(*) AS pairs, count(DISTINCT a.event_id) AS spans, count(DISTINCT c.event_id) AS lines FROM d2 a JOIN d3 c ON c.item_id = a.item_id AND a.end_s + 1.5e0 >= c.start_s AND a.start_s - 1.5e0 <= c.end_s GROUP BY a.item_id")
def overlap_pairs(spark, d):
    """Spans of speech and lines that overlap or are at most 1.5 seconds apart."""
    spans = derived.speech(spark, d)
    lines = derived.film_cues(spans, 9.0, 1.0).select("item_id", F.col("event_id").alias("line"), F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s"))
    met = intervals.overlapping(spans, lines, ["item_id"], ("start_s", "end_s"), ("from_s", "to_s"), 10.0, 1.5)
    return met.groupBy("item_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("event_id").alias("spans"), F.count_distinct("line").alias("lines"))


# fits and verdicts


@query(f"SELECT s_suppkey, rank, label, round(s_suppkey * 60 * scale, 6) AS at_s FROM supplier, (VALUES {', '.join(f'({k}, CAST({b!r} AS DOUBLE) / CAST({a!r} AS DOUBLE), {sql.q(l)})' for k, a, b, _, l in signals.frame_rates())}) f(rank, scale, label)")
def framerate_pairs(spark, d):
    """A minute mark for each supplier, under every ratio of two frame rates."""
    pairs = spark.createDataFrame(signals.frame_rates(), "rank int, from_fps double, to_fps double, scale double, label string")
    marks = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(k) for k in range(20)])).alias("rank"))
    return marks.join(F.broadcast(pairs), "rank").select("s_suppkey", "rank", "label", F.round(F.col("s_suppkey") * 60 * F.col("scale"), 6).alias("at_s"))


@query(f"WITH t AS (SELECT o_orderkey, 0.79 + (o_orderkey % 50000) / 100000e0 AS scale FROM orders) SELECT o_orderkey, CASE {' '.join(f'WHEN abs(scale - {s!r}) <= 0.0002 THEN {sql.q(l)}' for _, _, _, s, l in signals.frame_rates())} END AS label FROM t")
def framerate_identify(spark, d):
    scale = F.lit(0.79) + (F.col("o_orderkey") % 50000) / 100000.0
    return table(spark, d, "orders").select("o_orderkey", sync.identified_rate(scale)["label"].alias("label"))


def _fit_columns(rows):
    return rows.select("case_key", r6("offset_s"), r6("scale", 9), r6("residual_s"), "points", "frame_rate")


@query(f"WITH {sql.D5}, {sql.fit(False)} SELECT {sql.FIT_COLUMNS} FROM fit")
def drift_fit(spark, d):
    return _fit_columns(sync.drift_fit(derived.points(spark, d), "case_key", snap=False))


@query(f"WITH {sql.D5}, {sql.fit(True)} SELECT {sql.FIT_COLUMNS} FROM fit")
def drift_fit_snapped(spark, d):
    return _fit_columns(sync.drift_fit(derived.points(spark, d), "case_key"))


def _judged(spark, d):
    points = derived.points(spark, d)
    return sync.assessed(points, sync.drift_fit(points, "case_key"), "case_key", RUNTIME)


@query(f"WITH {sql.D5}, {sql.fit(True)}, {sql.ASSESS} SELECT case_key, anchors, confident, verdict, round(worst_s, 6) AS worst_s, repairable FROM done")
def sync_verdict(spark, d):
    return _judged(spark, d).select("case_key", "anchors", "confident", "verdict", r6("worst_s"), "repairable")


@query(f"WITH {sql.D5}, {sql.fit(True)}, {sql.ASSESS} SELECT case_key, repairable AND worst_s >= 0.6 AND confident >= 2 AND coalesce(mean_confidence, 0) >= 0.4 AS repair FROM done")
def should_repair(spark, d):
    return _judged(spark, d).select("case_key", sync.should_repair().alias("repair"))


@query(f"WITH {sql.D2}, {sql.d3(6.0, 25 / 24)} SELECT item_id, event_id, round((start_s - 6) / {25 / 24!r}, 6) AS start_s, round((end_s - 6) / {25 / 24!r}, 6) AS end_s FROM d3")
def retime_apply(spark, d):
    rows = derived.film_cues(derived.speech(spark, d), 6.0, 25 / 24)
    return cue_ops.retimed(rows, F.lit(6.0), F.lit(25 / 24)).select("item_id", "event_id", r6("start_s"), r6("end_s"))


@query(f"WITH {sql.D5}, {sql.fit(True)} SELECT case_key, round(offset_s, 6) AS at_start, round(offset_s + (scale - 1) * 5400, 6) AS at_end, printf('%.1f', abs(offset_s)) || CASE WHEN round(offset_s, 6) >= 0 THEN 's late' ELSE 's early' END AS said FROM fit")
def error_at(spark, d):
    fits = sync.drift_fit(derived.points(spark, d), "case_key")
    return fits.select("case_key", F.round(sync.error_at(F.lit(0.0)), 6).alias("at_start"), F.round(sync.error_at(F.lit(RUNTIME)), 6).alias("at_end"), sync.lateness(F.round("offset_s", 6)).alias("said"))


# reports


@query(f"WITH {sql.TRACKS}, {sql.COVER} SELECT item_id, lang2 AS lang, track_idx, verdict, cue_count FROM best")
def best_track(spark, d):
    return reports.best_tracks(derived.tracks(spark, d)).select("item_id", "lang", "track_idx", "verdict", "cue_count")


def _covered(spark, d):
    rows = derived.tracks(spark, d)
    return reports.coverage(rows, rows, LANGUAGES)


@query(f"WITH {sql.TRACKS}, {sql.COVER} SELECT verdict, count(*) AS n FROM covered WHERE verdict IS NOT NULL GROUP BY verdict")
def coverage_by_verdict(spark, d):
    return reports.by_verdict(_covered(spark, d))


@query(f"WITH {sql.TRACKS}, {sql.COVER} SELECT lang, count(*) AS n FROM covered WHERE verdict IS NULL GROUP BY lang")
def missing_languages(spark, d):
    return reports.missing(_covered(spark, d))


@query(f"WITH {sql.TRACKS}, {sql.COVER} SELECT item_id, bool_and(coalesce(verdict = 'InSync', FALSE)) AS covered FROM covered GROUP BY item_id")
def covered_items(spark, d):
    return reports.covered_items(_covered(spark, d))


@query(f"WITH {sql.TRACKS}, w AS (SELECT item_id, lang FROM (SELECT DISTINCT item_id FROM tracks), (VALUES {sql.WANTED}) w(lang)) SELECT item_id, lang FROM w WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.item_id = w.item_id AND skipped IS NULL AND cue_count > 0 AND {sql.normalized('t.language')} = w.lang)")
def missing_tracks(spark, d):
    rows = derived.tracks(spark, d)
    return reports.missing_tracks(rows, rows, LANGUAGES)


@query(f"""WITH {sql.TRACKS}, a AS (SELECT item_id, track_idx AS audio_idx, language AS l, track_idx = 2 AS def, CASE WHEN track_idx % 2 = 0 THEN 6 ELSE 2 END AS ch FROM tracks)
  SELECT item_id, track_idx, audio_idx FROM (SELECT t.item_id, t.track_idx, audio_idx, row_number() OVER (PARTITION BY t.item_id, t.track_idx ORDER BY l = t.language DESC, def DESC, ch DESC, audio_idx) AS r FROM tracks t JOIN a ON a.item_id = t.item_id) WHERE r = 1""")
def choose_audio(spark, d):
    rows = derived.tracks(spark, d)
    audio = rows.select("item_id", F.col("track_idx").alias("audio_idx"), F.col("language").alias("audio_language"), (F.col("track_idx") == 2).alias("is_default"), F.when(F.col("track_idx") % 2 == 0, 6).otherwise(2).alias("channels"))
    return reports.chosen_audio(rows, audio)


@query(f"WITH {sql.TRACKS} SELECT item_id, track_idx, CASE WHEN skipped IS NOT NULL THEN 'NoDialogue' WHEN toxic = 1 THEN 'WrongLanguage' WHEN cue_count = 0 THEN 'NoDialogue' ELSE verdict END AS verdict FROM tracks")
def track_verdict(spark, d):
    return derived.tracks(spark, d).select("item_id", "track_idx", reports.track_verdict(F.col("skipped"), F.col("toxic") == 1, F.col("cue_count"), F.col("verdict")).alias("verdict"))


_FILE_SQL = "SELECT doc_id, 'Film' || (doc_id // 4) || ['', '.en', '.fr.sdh', '.pt-BR', '.eng.cicada', '.heard.cicada-heard'][doc_id % 6 + 1] || ['.srt', '.ASS', '.txt', '.vtt'][doc_id % 4 + 1] AS name, 'Film' || (doc_id // 4) || '.mkv' AS media, doc_id, source FROM documents"


def _files(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", ".en", ".fr.sdh", ".pt-BR", ".eng.cicada", ".heard.cicada-heard")]), (F.col("doc_id") % 6 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".srt", ".ASS", ".txt", ".vtt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    film = F.concat(F.lit("Film"), F.floor(F.col("doc_id") / 4).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.concat(film, tail, ext).alias("name"), F.concat(film, F.lit(".mkv")).alias("media"))


@query(f"""WITH f AS ({_FILE_SQL}), p AS (SELECT doc_id, name, media, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext, regexp_replace(media, '\\.[^.]*$', '') AS base FROM f),
  l AS (SELECT *, list_filter(list_transform(string_split(substr(stem, length(base) + 2), '.'), lambda x: {sql.normalized('x')}), lambda x: x <> '') AS codes, list_contains(string_split(lower(stem), '.'), 'cicada-heard') AS h, list_contains(string_split(lower(stem), '.'), 'cicada') AS r FROM p)
  SELECT doc_id, name, CASE WHEN h THEN 'Heard' WHEN r THEN 'Repaired' ELSE 'External' END AS kind, ext IN ('.srt', '.ass', '.ssa', '.vtt', '.sub', '.sup', '.idx', '.smi') AND (lower(stem) = lower(base) OR starts_with(lower(stem), lower(base) || '.')) AS belongs, CASE WHEN starts_with(lower(stem), lower(base) || '.') THEN coalesce(codes[1], '') ELSE '' END AS lang FROM l""")
def sidecar_classify(spark, d):
    name, media = F.col("name"), F.col("media")
    return _files(spark, d).select("doc_id", "name", naming.classify(name, "cicada", "cicada-heard").alias("kind"), naming.belongs_to(name, media).alias("belongs"), naming.language_of(name, media).alias("lang"))


@query("SELECT page_id, 'file_' || substr(sha256(url), 1, 16) AS token FROM pages")
def file_token(spark, d):
    return table(spark, d, "pages").select("page_id", naming.file_token(F.col("url")).alias("token"))


@query(f"WITH f AS ({_FILE_SQL}) SELECT doc_id, regexp_replace(media, '\\.[^.]*$', '') || CASE WHEN doc_id % 5 > 0 THEN '.en' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '.sdh' ELSE '' END || '.cicada.srt' AS name FROM f")
def sidecar_name(spark, d):
    lang = F.when(F.col("doc_id") % 5 > 0, "en").otherwise("")
    return _files(spark, d).select("doc_id", naming.sidecar_name(F.col("media"), lang, F.col("doc_id") % 2 == 0, "cicada").alias("name"))


_SEEN = "s AS (SELECT user_id AS item_id, event_id, CASE WHEN event_type = 'error' THEN '' ELSE CAST(floor(value) AS BIGINT) || '-' || event_id % 3 END AS version FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY event_id DESC) AS r FROM s) WHERE r = 1)"


def _seen(spark, d):
    version = F.when(F.col("event_type") == "error", "").otherwise(commands.media_version(F.floor("value"), F.col("event_id") % 3))
    return table(spark, d, "events").select(F.col("user_id").alias("item_id"), "event_id", version.alias("version"))


@query(f"WITH {_SEEN} SELECT item_id, event_id, version FROM l")
def latest_report(spark, d):
    return reports.latest(_seen(spark, d), "item_id", "event_id")


@query(f"WITH {_SEEN}, i AS (SELECT c_custkey AS item_id, CAST(c_custkey % 50 AS VARCHAR) || '-' || c_custkey % 3 AS version FROM customer) SELECT i.item_id, i.version FROM i LEFT JOIN l ON i.item_id = l.item_id WHERE l.item_id IS NULL OR (coalesce(l.version, '') <> '' AND l.version <> i.version)")
def needs_check(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), commands.media_version(F.col("c_custkey") % 50, F.col("c_custkey") % 3).alias("version"))
    return reports.needs_check(items, latest_report(spark, d))


_RUN_SQL = "e AS (SELECT user_id % 20 AS run_id, event_id, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS at_s FROM events WHERE ts IS NOT NULL)"


def _runs(spark, d):
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(1e6)
    return table(spark, d, "events").where("ts is not null").select((F.col("user_id") % 20).alias("run_id"), "event_id", "value", at.alias("at_s"))


@query(f"WITH {_RUN_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY at_s DESC) AS r FROM e) SELECT run_id, CASE WHEN count(*) >= 3 AND 2592000 - min(at_s) > 0 THEN round(40 / ((count(*) - 1) / (2592000 - min(at_s))), 4) END AS seconds_left FROM k WHERE r <= 20 GROUP BY run_id")
def run_estimate(spark, d):
    return reports.time_left(_runs(spark, d), 40, F.lit(2592000.0), "run_id").select("run_id", r6("seconds_left", 4))


@query(f"WITH {_RUN_SQL} SELECT run_id, event_id, round(coalesce(sum(greatest(value, 0)) OVER w, 0), 3) AS spent_before, coalesce(sum(greatest(value, 0)) OVER w, 0) < 500 AS admitted FROM e WINDOW w AS (PARTITION BY run_id ORDER BY at_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def run_budget(spark, d):
    done = reports.admitted(_runs(spark, d), 500.0, "run_id", ["at_s", "event_id"], "value")
    return done.select("run_id", "event_id", r6("spent_before", 3), "admitted")


# transcripts


@query(f"WITH {sql.D1} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) - 1 AS INTEGER) AS seg_idx, CAST(cue_idx AS DOUBLE) AS start_s, cue_idx + 0.9e0 AS end_s, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM d1 WHERE regexp_matches(text, '\\S')")
def openai_parse(spark, d):
    segment = F.struct(F.col("cue_idx").alias("start"), (F.col("cue_idx") + 0.9).alias("end"), "text")
    bodies = derived.cues(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    bodies = bodies.select("track_id", F.to_json(F.struct(F.lit("english").alias("language"), F.lit("x").alias("text"), "segments")).alias("body"), F.lit(600.0).alias("duration_s"))
    found = transcripts.segment_rows(transcripts.verbose_json(bodies, "track_id"), "track_id")
    return found.select("track_id", "seg_idx", r6("start_s"), r6("end_s"), "text")


@query(f"WITH {sql.D1} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) - 1 AS INTEGER) AS seg_idx, least(CAST(cue_idx AS DOUBLE), 4) AS start_s, least(cue_idx + 0.9e0, 4) AS end_s, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM d1 WHERE regexp_matches(text, '\\S')")
def google_parse(spark, d):
    segment = F.struct(F.col("cue_idx").alias("start"), (F.col("cue_idx") + 0.9).cast("string").alias("end"), "text")
    inner = derived.cues(spark, d).groupBy("track_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(segment)).alias("segments"))).alias("t"))
    cut = F.floor(F.length("t") / 2).cast("int")
    parts = F.array(F.struct(F.substr("t", F.lit(1), cut).alias("text")), F.struct(F.substr("t", cut + 1, F.length("t")).alias("text")))
    bodies = inner.select("track_id", F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))).alias("body"), F.lit(4.0).alias("duration_s"))
    found = transcripts.segment_rows(transcripts.candidate_json(bodies, "track_id"), "track_id")
    return found.select("track_id", "seg_idx", r6("start_s"), r6("end_s"), "text")


def _said(spark, d):
    """Segments cut every few words, close to each other."""
    rows = cue_ops.timed_tokens(derived.cues(spark, d)).withColumn("g", F.floor(F.col("i") / 6))
    said = rows.groupBy("track_id", "cue_idx", "g").agg(F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.array_join(F.array_sort(F.collect_list(F.struct("i", "word")))["word"], " ").alias("text"))
    return said.select("track_id", (F.col("cue_idx") * 10000 + F.col("g")).cast("int").alias("cue_idx"), "start_s", "end_s", F.when(F.col("g") % 3 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))


@query(f"WITH RECURSIVE {sql.D1}, {sql.SAID}, {sql.JOINED} SELECT track_id, CAST(seg_idx AS INTEGER) AS seg_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, text FROM joined")
def cue_join(spark, d):
    return cue_ops.joined_segments(_said(spark, d)).select("track_id", "seg_idx", r6("start_s"), r6("end_s"), "text")


@query(f"WITH RECURSIVE {sql.D1}, {sql.SAID}, {sql.JOINED}, {sql.SPLIT} SELECT track_id, CAST(cue_idx AS INTEGER) AS cue_idx, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, {sql.wrap('piece')} AS text FROM tidy WHERE end_s > start_s")
def cue_split(spark, d):
    return cue_ops.transcript_cues(_said(spark, d)).select("track_id", "cue_idx", r6("start_s"), r6("end_s"), "text")


@query(f"""WITH {sql.D1}, c AS (SELECT track_id, cue_idx, greatest(start_s * 0.3e0 - 181, 0) AS start_s, end_s * 0.3e0 - 181 AS e FROM d1), k AS (SELECT *, start_s + least(greatest(e - start_s, 1), 7) AS x, lead(start_s) OVER (PARTITION BY track_id ORDER BY start_s, cue_idx) AS n FROM c)
  SELECT track_id, cue_idx, round(start_s, 6) AS start_s, round(least(x, coalesce(n, x)), 6) AS end_s FROM k WHERE least(x, coalesce(n, x)) > start_s""")
def cue_tidy(spark, d):
    rows = derived.cues(spark, d).withColumns({"start_s": F.col("start_s") * 0.3 - 181, "end_s": F.col("end_s") * 0.3 - 181, "text": F.lit("x")})
    return cue_ops.tidied(rows).select("track_id", "cue_idx", r6("start_s"), r6("end_s"))


_LINE = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


@query(f"""WITH {sql.D1}, l AS (SELECT track_id, cue_idx, {_LINE} AS t FROM d1), b AS (SELECT *, list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = ' ') AS s FROM l),
  m AS (SELECT *, list_min(list_transform(s, lambda i: abs(i - 1 - length(t) // 2) * 1000000 + i)) % 1000000 AS cut FROM b) SELECT track_id, cue_idx, CASE WHEN length(t) > 42 AND len(s) > 0 THEN substr(t, 1, cut - 1) || chr(10) || substr(t, cut + 1) ELSE t END AS text FROM m""")
def cue_wrap(spark, d):
    return derived.cues(spark, d).select("track_id", "cue_idx", text.wrapped(F.col("text")).alias("text"))


@query("WITH i AS (SELECT doc_id, n_chars * 1e0 AS r FROM documents WHERE n_chars > 0), p AS (SELECT doc_id, r, unnest(range(CAST(ceil(r / 600) AS INTEGER))) AS k FROM i) SELECT doc_id, CAST(k AS INTEGER) AS piece_idx, k * 600e0 AS start_s, least(600, r - k * 600) AS duration_s FROM p")
def pieces(spark, d):
    items = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("r"))
    return transcripts.pieces(items, "doc_id", "r")


@query("SELECT url, '-nostdin -hide_banner -loglevel error -accurate_seek -ss ' || CAST(greatest(page_id - 2, 0) AS VARCHAR) || ' -i \"' || url || '\" -ss ' || CAST(least(2, page_id) AS VARCHAR) || ' -t 30 -map 0:1 -vn -sn -dn -ac 1 -ar 16000 -c:a libopus -b:a 16k -f ogg pipe:1' AS command FROM pages")
def clip_command(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("url", commands.clip_arguments(F.col("url"), F.col("page_id").cast("double"), F.lit(30.0), F.lit(1)).alias("command"))


@query("SELECT source, CAST(sum(n_chars) AS DOUBLE) / 60 AS minutes, sum(CAST(0.006 AS DECIMAL(18,6)) * n_chars) AS cost FROM documents GROUP BY source")
def audio_cost(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(commands.audio_minutes(F.col("n_chars")).alias("minutes"), F.sum(commands.price(F.lit("0.006").cast("decimal(18,6)"), F.col("n_chars") * 60)).cast("double").alias("cost"))


# the library


_ITEM_SQL = "SELECT doc_id AS item_id, ['Movie', 'Episode', 'Series'][doc_id % 3 + 1] AS kind, doc_id % 11 = 0 AS virtual, n_chars > 500 AS has_subtitles, CASE WHEN doc_id % 13 = 0 THEN '' ELSE source || '/' || doc_id END AS path FROM documents"


@query(f"SELECT item_id, kind, path FROM ({_ITEM_SQL}) WHERE kind IN ('Movie', 'Episode') AND NOT virtual AND has_subtitles AND path <> ''")
def eligible_items(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Movie", "Episode", "Series")]), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), kind.alias("kind"), (F.col("doc_id") % 11 == 0).alias("virtual"), (F.col("n_chars") > 500).alias("has_subtitles"), path.alias("path"))
    return library.eligible(items, ["Movie", "Episode"]).select("item_id", "kind", "path")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_name, p_partkey LIMIT 30")
def item_search(spark, d):
    return library.searched(table(spark, d, "part"), " Widget ", 30, "p_name", "p_partkey").select("p_partkey", "p_name")


@query("WITH s AS (SELECT doc_id // 4 AS item_id, doc_id % 4 AS k, doc_id, lang, source, n_chars FROM documents) SELECT 'text' AS part, item_id, CAST(k AS INTEGER) AS track_idx, coalesce(lang, '') AS language, k = 2 AS is_text, -1 AS channels FROM s WHERE k >= 2 UNION ALL SELECT 'sound', item_id, CAST(k AS INTEGER), coalesce(lang, ''), FALSE, CAST(n_chars % 8 AS INTEGER) FROM s WHERE k = 1")
def streams_by_type(spark, d):
    """Streams of media files: a picture, a sound and two subtitle tracks each."""
    k = (F.col("doc_id") % 4).cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Video", "Audio", "Subtitle", "Subtitle")]), k + 1)
    streams = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("item_id"), kind.alias("type"), k.alias("index"), F.col("lang").alias("language"), F.col("source").alias("title"), (k == 2).alias("is_text"), F.lit(False).alias("is_forced"), (k == 3).alias("is_default"), (F.col("n_chars") % 8).cast("int").alias("channels"))
    text_ = library.subtitle_tracks(streams).select(F.lit("text").alias("part"), "item_id", "track_idx", "language", "is_text", F.lit(-1).alias("channels"))
    return text_.unionByName(library.audio_tracks(streams).select(F.lit("sound").alias("part"), "item_id", F.col("audio_idx").alias("track_idx"), F.col("audio_language").alias("language"), F.lit(False).alias("is_text"), "channels"))


_SOURCES_SQL = f"""t AS (SELECT item_id, track_idx, language, CASE WHEN track_idx = 3 THEN '/m/FILM' || item_id || '.EN.SRT' WHEN track_idx = 2 THEN '/m/Film' || item_id || '.cicada.srt' END AS path, cue_count % 5 > 0 AS is_text, cue_count % 4 = 0 AS is_forced FROM tracks),
  f AS (SELECT doc_id // 4 AS item_id, '/m/Film' || (doc_id // 4) || ['.en.srt', '.fr.forced.vtt', '.txt', '.it.heard.cicada-heard.sup'][doc_id % 4 + 1] AS path, doc_id % 4 AS k FROM documents),
  s AS (SELECT item_id, 'stream_' || track_idx AS source_id, CASE WHEN path IS NULL THEN 'Embedded' WHEN track_idx = 2 THEN 'Repaired' ELSE 'External' END AS kind, track_idx AS stream_idx, {sql.normalized('language')} AS lang, is_text, is_forced, path FROM t
    UNION ALL SELECT item_id, 'file_' || substr(sha256(path), 1, 16), CASE WHEN k = 3 THEN 'Heard' ELSE 'External' END, NULL, ['en', 'fr', '', 'it'][k + 1], k < 3, k = 1, path FROM f WHERE k <> 2 AND NOT EXISTS (SELECT 1 FROM t WHERE t.item_id = f.item_id AND lower(t.path) = lower(f.path)))"""


def _sources(spark, d):
    rows = derived.tracks(spark, d)
    film = F.col("item_id").cast("string")
    path = F.when(F.col("track_idx") == 3, F.concat(F.lit("/m/FILM"), film, F.lit(".EN.SRT"))).when(F.col("track_idx") == 2, F.concat(F.lit("/m/Film"), film, F.lit(".cicada.srt")))
    tracks = rows.select("item_id", "track_idx", "language", path.alias("path"), (F.col("cue_count") % 5 > 0).alias("is_text"), (F.col("cue_count") % 4 == 0).alias("is_forced"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (".en.srt", ".fr.forced.vtt", ".txt", ".it.heard.cicada-heard.sup")]), (F.col("doc_id") % 4 + 1).cast("int"))
    film = F.concat(F.lit("/m/Film"), F.floor(F.col("doc_id") / 4).cast("string"))
    files = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("item_id"), F.concat(film, tail).alias("path"), F.concat(film, F.lit(".mkv")).alias("media"))
    return library.inventory(tracks, files, "cicada", "cicada-heard"), rows


@query(f"WITH {sql.TRACKS}, {_SOURCES_SQL} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY list_position(['Embedded', 'External', 'Repaired', 'Heard'], kind), lang, coalesce(stream_idx, 1000), source_id) AS INTEGER) AS place, source_id, kind, lang, is_text, is_forced FROM s")
def inventory_sources(spark, d):
    return _sources(spark, d)[0].select("item_id", "place", "source_id", "kind", "lang", "is_text", "is_forced")


@query(f"WITH {sql.TRACKS}, {_SOURCES_SQL}, w AS (SELECT item_id, lang FROM (SELECT DISTINCT item_id FROM tracks), (VALUES {sql.WANTED}) w(lang)) SELECT item_id, lang FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item_id = w.item_id AND s.lang = w.lang AND is_text AND NOT is_forced)")
def inventory_missing(spark, d):
    sources, items = _sources(spark, d)
    return library.without_language(sources, items, LANGUAGES)


@query(f"WITH {sql.TRACKS}, {sql.COVER} SELECT DISTINCT item_id FROM covered WHERE verdict = 'Drifting'")
def reports_with_verdict(spark, d):
    return library.with_verdict(derived.tracks(spark, d), "drifting", LANGUAGES)


@query(f"WITH {sql.TRACKS} SELECT DISTINCT item_id FROM tracks WHERE verdict = 'Mismatched'")
def reports_with_any_track(spark, d):
    return library.with_verdict(derived.tracks(spark, d), "mismatched", [])


@query("SELECT event_id AS run_id, CASE WHEN event_id % 2 = 0 AND event_id % 7 <> 0 THEN 'Abandoned' WHEN event_id % 2 = 0 THEN 'Running' ELSE 'Completed' END AS status FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(spark, d):
    runs = table(spark, d, "events").where("ts is not null").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 2 == 0, "Running").otherwise("Completed").alias("status"))
    return library.recent_runs(runs, runs.where("run_id % 7 = 0")).select("run_id", "status")


@query(f"WITH {sql.D1}, c AS (SELECT track_id, cue_idx, {sql.clean('text')} AS clean FROM d1), k AS (SELECT *, lag(lower(clean)) OVER (PARTITION BY track_id ORDER BY cue_idx) AS b FROM c WHERE clean <> ''), n AS (SELECT track_id, cue_idx, clean, row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) - 1 AS k, count(*) OVER (PARTITION BY track_id) // 4 AS f FROM k WHERE b IS NULL OR b <> lower(clean)) SELECT track_id, string_agg(clean, ' ' ORDER BY cue_idx) AS sample FROM n WHERE k >= f AND k < f + 400 GROUP BY track_id")
def dialogue_sample(spark, d):
    return library.dialogue_sample(derived.cues(spark, d))


# tracks too short for a window of 30 seconds have one over all of them
_HEARD_SQL = f"""{sql.D1.replace('600 + 3 * turn', '3 * turn')}, whole AS (SELECT track_id, max_by(end_s, (start_s, cue_idx)) AS total FROM d1 GROUP BY track_id),
  {sql.VOTE.replace("tok AS (SELECT track_id,", "tok AS (SELECT track_id, heard,").replace("AS w FROM d1)", "AS w, start_s - 2.5 >= 0 AND start_s - 2.5 <= total AS heard FROM d1 JOIN whole USING (track_id))").replace("count(*) OVER (PARTITION BY track_id, word) AS nh FROM tok WHERE length(word) >= 2", "count(*) OVER (PARTITION BY track_id, word) AS nh FROM tok WHERE heard AND length(word) >= 2")}, {sql.PEAK},
  d5 AS (SELECT track_id AS case_key, total / 2 AS at_s, peak * 0.2e0 AS offset_s, greatest(0, least(1, agree / mass.total * (1 - coalesce(rh, 0) / height))) AS confidence FROM mass LEFT JOIN rival USING (track_id) JOIN whole USING (track_id) WHERE votes > 0)"""


@query(f"WITH {_HEARD_SQL.replace('total / 2 AS at_s', 'whole.total / 2 AS at_s')}, {sql.fit(True)}, {sql.ASSESS} SELECT case_key AS track_id, anchors, confident, verdict, round(offset_s, 3) AS offset_s, round(worst_s, 3) AS worst_s FROM done LEFT JOIN fit USING (case_key)")
def transcript_verdict(spark, d):
    """Each track heard 2.5 seconds early in the windows planned for it; every other window without times."""
    cues = derived.cues(spark, d).withColumns({"start_s": F.col("start_s") - 600, "end_s": F.col("end_s") - 600})
    anchors = kept(cue_ops.anchor_windows(cues, F.lit(0.0)).withColumn("timed", F.col("anchor_idx") % 2 == 0), "anchors")
    near = cues.join(anchors.select("track_id", "anchor_idx", F.col("start_s").alias("a"), "duration_s"), "track_id").where("start_s - 2.5 >= a and start_s - 2.5 <= a + duration_s")
    heard = near.select("track_id", "anchor_idx", (F.col("start_s") - 2.5).alias("start_s"), (F.col("end_s") - 2.5).alias("end_s"), "text")
    points = kept(library.heard_points(cues, anchors, heard, 30.0), "points")
    done = sync.assessed(points, sync.drift_fit(points, "track_id"), "track_id", RUNTIME)
    return done.select("track_id", "anchors", "confident", "verdict", r6("offset_s", 3), r6("worst_s", 3))


@query("SELECT count(*) AS items, count(*) * 2.5e0 AS minutes, count(*) * 2.5e0 > 240 AS over_budget FROM documents")
def run_quote(spark, d):
    return table(spark, d, "documents").agg(*Settings(by_transcript=True).quote(F.count(F.lit(1))))


@query(f"""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE regexp_replace(printf('%.1f', round(n_chars / 1024e0, 1)), '\\.0$', '') || ' KB' END AS size,
  '#' || doc_id % 4 || ' ' || name || ' (' || CASE WHEN doc_id % 3 = 1 THEN 'external' ELSE 'embedded' END || CASE WHEN doc_id % 5 = 0 THEN ', forced' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ', SDH' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ', image' ELSE '' END || ')' AS track
  FROM (SELECT *, MAP {{{', '.join(f'{sql.q(a)}: {sql.q(b)}' for a, b in language.NAMES.items())}}}[lang] AS name FROM documents)""")
def source_labels(spark, d):
    on = lambda k, r=0: F.col("doc_id") % k == r
    track = naming.track_label(F.col("doc_id") % 4, F.col("lang"), on(3, 1), on(5), on(7), ~on(2))
    return table(spark, d, "documents").select("doc_id", naming.file_size(F.col("n_chars")).alias("size"), track.alias("track"))


# what remains of reports, files and stores


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pictures, not text' WHEN doc_id % 3 = 0 THEN 'forced lines only' END AS skipped FROM documents")
def skip_reasons(spark, d):
    return table(spark, d, "documents").select("doc_id", reports.skip_reason(F.col("doc_id") % 4 != 0, F.col("doc_id") % 3 == 0).alias("skipped"))


@query(f"WITH {sql.TRACKS} SELECT 'some' AS asked, item_id, track_idx FROM tracks WHERE {sql.normalized('language')} IN ('fr', 'it') UNION ALL SELECT 'none', item_id, track_idx FROM tracks")
def wanted_tracks(spark, d):
    rows = derived.tracks(spark, d)
    asked = [("some", ["French", "ita", ""]), ("none", [])]
    found = [reports.tracks_in(rows, languages).select(F.lit(name).alias("asked"), "item_id", "track_idx") for name, languages in asked]
    return found[0].unionByName(found[1])


@query(f"""WITH {sql.TRACKS}, a AS (SELECT item_id, track_idx AS audio_idx, language AS l, track_idx = 2 AS def, CASE WHEN track_idx % 2 = 0 THEN 6 ELSE 2 END AS ch FROM tracks),
  c AS (SELECT item_id, track_idx, audio_idx FROM (SELECT t.item_id, t.track_idx, audio_idx, row_number() OVER (PARTITION BY t.item_id, t.track_idx ORDER BY l = t.language DESC, def DESC, ch DESC, audio_idx) AS r FROM tracks t JOIN a ON a.item_id = t.item_id) WHERE r = 1)
  SELECT item_id, audio_idx, string_agg(CAST(track_idx AS VARCHAR), ',' ORDER BY track_idx) AS tracks, count(*) AS n FROM c GROUP BY item_id, audio_idx""")
def audio_groups(spark, d):
    rows = derived.tracks(spark, d)
    audio = rows.select("item_id", F.col("track_idx").alias("audio_idx"), F.col("language").alias("audio_language"), (F.col("track_idx") == 2).alias("is_default"), F.when(F.col("track_idx") % 2 == 0, 6).otherwise(2).alias("channels"))
    return reports.by_audio(rows, audio).withColumn("tracks", F.array_join(F.col("tracks").cast("array<string>"), ","))


@query("SELECT 'some' AS part, count(*) AS items, round(sum(n_chars * 1e0) / 60, 6) AS minutes, sum(CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS DOUBLE) END) AS cost FROM documents UNION ALL SELECT 'none', count(*), 0, NULL FROM documents WHERE doc_id < 0")
def coverage_minutes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("audio_s"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("double")).alias("cost"))
    parts = [reports.audio_minutes(x, cost="cost").select(F.lit(name).alias("part"), "items", r6("minutes"), "cost") for name, x in (("some", rows), ("none", rows.where("doc_id < 0")))]
    return parts[0].unionByName(parts[1])


_REPAIR_SQL = f"""{sql.D1}, k AS (SELECT track_id, CASE track_id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 2.5e0 WHEN 2 THEN -1e0 ELSE 0e0 END AS o, CASE track_id % 5 WHEN 3 THEN 1.25e0 WHEN 4 THEN -1e0 ELSE 1e0 END AS s,
    CASE WHEN track_id % 11 <> 0 THEN CASE WHEN track_id % 2 = 0 THEN '/films/' || track_id ELSE '/store' END || '/Film ' || track_id || CASE WHEN track_id % 3 = 0 THEN '' ELSE '.en' END || CASE WHEN track_id % 4 = 0 THEN '.sdh' ELSE '' END || '.repaired.srt' END AS path FROM (SELECT DISTINCT track_id FROM d1)),
  m AS (SELECT d.track_id, path, cue_idx, greatest((start_s - o) / s, 0) AS a, greatest((end_s - o) / s, (start_s - o) / s, 0) AS b, text FROM d1 d JOIN k ON k.track_id = d.track_id WHERE path IS NOT NULL AND s > 0 AND NOT (abs(o) < 1e-6 AND abs(s - 1) < 1e-9)),
  n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY a, cue_idx) AS k FROM m)"""


@query(f"WITH {_REPAIR_SQL} SELECT track_id, path, sha256(string_agg(k || chr(13) || chr(10) || {sql.stamp('a')} || ' --> ' || {sql.stamp('b')} || chr(13) || chr(10) || regexp_replace(text, '\\r?\\n', chr(13) || chr(10), 'g') || chr(13) || chr(10), chr(13) || chr(10) ORDER BY k)) AS srt_sha256 FROM n GROUP BY track_id, path")
def repair_sidecars(spark, d):
    """Repaired copies beside their films or in a folder of the store; tracks that nothing changes have none."""
    return _repairs(derived.cues(spark, d)).select("track_id", "path", F.sha2(F.encode("srt", "UTF-8"), 256).alias("srt_sha256"))


def _repairs(cues, root=""):
    """(track_id, path, srt) of ``repair_sidecars``, under a folder."""
    t = F.col("track_id")
    of = lambda *cases: F.element_at(F.array(*[F.lit(c) for c in cases]), (t % 5 + 1).cast("int"))
    media = F.when(t % 11 != 0, F.concat(F.lit(f"{root}/films/"), t.cast("string"), F.lit("/Film "), t.cast("string"), F.lit(".mkv"))).otherwise(" ")
    path = repairs.repair_path(media, F.when(t % 3 != 0, "en").otherwise(""), t % 4 == 0, "repaired", t % 2 == 0, F.lit(f"{root}/store"))
    corrections = cues.select("track_id").distinct().select("track_id", of(0.0, 2.5, -1.0, 0.0, 0.0).alias("offset_s"), of(1.0, 1.0, 1.0, 1.25, -1.0).alias("scale"), path.alias("path"))
    return repairs.repaired(cues, corrections)


def _inside(root, path="path"):
    """A path without what leads to a folder of the session."""
    return F.regexp_replace(path, ".*/" + root.rsplit("/", 1)[-1], "")


@query(f"""WITH {_REPAIR_SQL} SELECT path, CAST(k - 1 AS INTEGER) AS cue_idx, floor(round(a * 1000, 3)) / 1000 AS start_s, floor(round(b * 1000, 3)) / 1000 AS end_s, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM n""")
def repair_files(spark, d):
    """The repaired copies written as files, in two phases, and read again."""
    root = work_dir(spark, "films")
    cues = derived.cues(spark, d).withColumn("text", text.collapsed(F.col("text")))
    told = repairs.written(_repairs(cues, root), work_dir(spark, "log"), ["repaired"])
    if not told.where("not done").isEmpty():
        raise RuntimeError("a repaired copy was not written")
    back = srt.read_srt(spark, root)
    return back.select(_inside(root, "track_id").alias("path"), "cue_idx", r6("start_s", 3), r6("end_s", 3), "text")


_SHELF_SQL = f"""{sql.D1}, t AS (SELECT track_id, count(*) AS n, min(start_s) AS first FROM d1 GROUP BY track_id), s AS (SELECT *, '/Film' || track_id || CASE WHEN track_id % 2 = 0 THEN '.en.srt' ELSE '.repaired.srt' END AS own, '/Film' || track_id || '.copy.repaired.srt' AS copy FROM t),
  kept AS (SELECT own AS path, n, CASE WHEN track_id % 4 = 1 THEN first - 2.5 ELSE first END AS first FROM s WHERE track_id % 4 <> 2 UNION ALL SELECT copy, n, first - 2.5 FROM s WHERE track_id % 4 IN (0, 3))"""


@query(f"WITH {_SHELF_SQL} SELECT path, n AS cues, round(first, 3) AS first_s FROM kept")
def edited_files(spark, d):
    """Files of which some are ours: retimed in place or as copies, extracted, removed; then read again."""
    root = work_dir(spark, "shelf")
    cues = derived.cues(spark, d).withColumn("text", text.collapsed(F.col("text")))
    t, film = F.col("track_id"), F.concat(F.lit(f"{root}/Film"), F.col("track_id").cast("string"))
    path, ours = F.concat(film, F.when(t % 2 == 0, ".en.srt").otherwise(".repaired.srt")), t % 2 == 1
    before = cue_ops.srt_text(cues)
    files.apply_edits(before.select(path.alias("path"), F.col("srt").alias("content")), work_dir(spark, "log"), [])
    sources = before.select(F.col("track_id").alias("item_id"), F.lit("file").alias("source_id"), F.when(ours, "Repaired").otherwise("External").alias("kind"), path.alias("path"))
    action = F.element_at(F.array(*[F.lit(a) for a in ("Retime", "Retime", "Delete", "Extract")]), (t % 4 + 1).cast("int"))
    edits = before.select(F.col("track_id").alias("item_id"), F.lit("file").alias("source_id"), action.alias("action"), F.lit(1).alias("cues"), F.lit(2.5).alias("offset_s"), F.lit(1.0).alias("scale"), F.concat(film, F.lit(".copy.repaired.srt")).alias("copy_path"))
    moved = cue_ops.srt_text(cue_ops.retimed(cues, F.lit(2.5), F.lit(1.0))).select(F.col("track_id").alias("item_id"), F.lit("file").alias("source_id"), F.col("srt").alias("content"))
    told = repairs.carried_out(sources, edits, moved, work_dir(spark, "log"), ["repaired"])
    if not told.where("not done").isEmpty():
        raise RuntimeError("an edit was not carried out")
    rows = srt.read_tracks(spark, root)
    return rows.select(_inside(root, "track_id").alias("path"), F.size("cues").cast("long").alias("cues"), F.round(F.array_min("cues.start_s"), 3).alias("first_s"))


@query(f"WITH {sql.D1}, t AS (SELECT track_id, string_agg(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' '), '' ORDER BY cue_idx) AS said, count(*) AS n FROM d1 GROUP BY track_id) SELECT '/' || track_id || '.srt' AS path, CASE track_id % 4 WHEN 0 THEN n WHEN 1 THEN n ELSE 0 END AS cues, CASE track_id % 4 WHEN 1 THEN 'the track held no dialogue once annotations were removed' WHEN 2 THEN 'the track parsed to no cues at all' WHEN 3 THEN 'the track parsed to no cues at all' END AS error FROM t")
def tracks_read(spark, d):
    """Files with dialogue, with notes alone, without a time and empty ones, each with its reason."""
    root, t = work_dir(spark, "tracks"), F.col("track_id")
    spoken = F.when(t % 4 == 1, "[door creaks]").otherwise(F.concat(F.lit("well "), text.collapsed(F.col("text"))))
    rows = cue_ops.srt_text(derived.cues(spark, d).withColumn("text", spoken))
    content = F.when(t % 4 == 2, F.replace("srt", F.lit("-->"), F.lit("to"))).when(t % 4 == 3, "").otherwise(F.col("srt"))
    files.apply_edits(rows.select(F.concat(F.lit(f"{root}/"), t.cast("string"), F.lit(".srt")).alias("path"), content.alias("content")), work_dir(spark, "log"), [])
    found = srt.read_tracks(spark, root)
    return found.select(_inside(root, "track_id").alias("path"), F.size("cues").cast("long").alias("cues"), "error")


@query("SELECT l_orderkey, l_linenumber, abs(o) < 1e-6 AND abs(s - 1) < 1e-9 AS same FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 3) * 5e-7 AS o, 1 + (l_linenumber % 3) * 6e-10 AS s FROM lineitem)")
def identity_corrections(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", repairs.is_identity(F.col("l_orderkey") % 3 * 5e-7, 1 + F.col("l_linenumber") % 3 * 6e-10).alias("same"))


_EDIT_SQL = f"""e AS (SELECT item_id, source_id, a.action, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 7 END AS cues, CASE WHEN item_id % 3 = 0 THEN 0e0 ELSE 1.1e0 END AS scale FROM (SELECT item_id, source_id FROM s UNION ALL SELECT DISTINCT item_id, 'gone' FROM s) x, (VALUES ('Save'), ('Retime'), ('Extract'), ('Delete')) a(action)),
  j AS (SELECT e.*, s.kind, s.path, s.source_id IS NOT NULL AS known, '/m/copy' || e.item_id || '.srt' AS copy FROM e LEFT JOIN s ON s.item_id = e.item_id AND s.source_id = e.source_id),
  r AS (SELECT *, CASE WHEN NOT known THEN 'that subtitle is no longer there' WHEN action = 'Retime' AND scale <= 0 THEN 'that is not a timing change that can be applied' WHEN action <> 'Delete' AND cues = 0 THEN 'that is not a subtitle file that can be read: nothing was saved' WHEN action = 'Delete' AND path IS NULL THEN 'this track lives inside the media file: extract it first' END AS why,
    action = 'Delete' OR (action IN ('Save', 'Retime') AND kind IN ('Heard', 'Repaired') AND path IS NOT NULL) AS own FROM j)"""


@query(f"""WITH {sql.TRACKS}, {_SOURCES_SQL}, {_EDIT_SQL} SELECT item_id, source_id, action, why IS NULL AS done, CASE WHEN why IS NULL THEN CASE WHEN own THEN path ELSE copy END END AS target,
  coalesce(why, CASE WHEN action = 'Delete' THEN 'deleted ' || regexp_replace(path, '^.*/', '') WHEN own THEN 'saved ' || cues || ' cues to ' || regexp_replace(path, '^.*/', '') WHEN action = 'Extract' THEN 'saved as copy' || item_id || '.srt' ELSE 'the original was left alone and a copy was saved as copy' || item_id || '.srt' END) AS message FROM r""")
def subtitle_edits(spark, d):
    sources, _ = _sources(spark, d)
    asked = sources.select("item_id", "source_id").unionByName(sources.select("item_id").distinct().withColumn("source_id", F.lit("gone")))
    edits = asked.select("item_id", "source_id", F.explode(F.array(*[F.lit(a) for a in ("Save", "Retime", "Extract", "Delete")])).alias("action"), F.when(F.col("item_id") % 5 == 0, 0).otherwise(7).alias("cues"), F.lit(1.0).alias("offset_s"), F.when(F.col("item_id") % 3 == 0, 0.0).otherwise(1.1).alias("scale"), F.concat(F.lit("/m/copy"), F.col("item_id").cast("string"), F.lit(".srt")).alias("copy_path"))
    return repairs.edited(sources, edits)


@query(f"WITH {sql.TRACKS}, {_SOURCES_SQL} SELECT s.item_id, s.source_id, t.verdict FROM s LEFT JOIN tracks t ON t.item_id = s.item_id AND t.track_idx = s.stream_idx AND t.cue_count % 3 > 0")
def inventory_reports(spark, d):
    sources, tracks = _sources(spark, d)
    stored = tracks.where("cue_count % 3 > 0").select("item_id", F.col("track_idx").alias("stream_idx"), "verdict")
    return library.with_reports(sources, stored).select("item_id", "source_id", "verdict")


_STORE = "item_id long, checked_at long, event_id long, version string"


@query("WITH s AS (SELECT user_id AS item_id, epoch_us(ts) AS checked_at, event_id, event_type AS version FROM events WHERE ts IS NOT NULL) SELECT item_id, checked_at, version FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY checked_at DESC, event_id DESC) AS r FROM s) WHERE r = 1 UNION ALL SELECT -1, count(DISTINCT item_id), 'cleared' FROM s")
def report_store(spark, d):
    """Reports saved in three parts to a store, its rows; and how many a store had that was cleared, under item -1."""
    rows = table(spark, d, "events").where("ts is not null").select(F.col("user_id").cast("long").alias("item_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("checked_at"), F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("version"))
    held, gone = work_dir(spark, "reports"), work_dir(spark, "cleared")
    for part in range(3):
        store.save_reports(rows.where(F.col("event_id") % 3 == part), held, tie="event_id", buckets=8)
    store.save_reports(rows, gone, tie="event_id", buckets=8)
    n = store.clear_reports(spark, gone, _STORE)
    left = store.stored_reports(spark, gone, _STORE).count()
    found = store.stored_reports(spark, held, _STORE).select("item_id", "checked_at", "version")
    return found.unionByName(spark.createDataFrame([(-1, n - left, "cleared")], "item_id long, checked_at long, version string"))


@query("""WITH e AS (SELECT 'run_' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') AS run_id, event_id % 24 AS k, ts, value, event_id FROM events WHERE ts IS NOT NULL AND event_id % 24 >= 4),
  r AS (SELECT run_id, k, count(*) AS items, count(*) FILTER (event_id % 10 = 0) AS failed, round(sum(coalesce(greatest(value, 0), 0)) / 60, 4) AS minutes, CASE WHEN k % 5 > 0 THEN CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0.25 END) AS DOUBLE) END AS cost FROM e GROUP BY run_id, k)
  SELECT run_id, CASE WHEN k % 3 = 1 THEN 'Completed' WHEN k % 3 = 2 THEN 'Failed' WHEN k % 2 = 0 THEN 'Running' ELSE 'Abandoned' END AS status, CAST(k * 10 AS INTEGER) AS planned, items, failed, minutes, cost, CASE WHEN k % 3 = 2 THEN 'stopped' END AS error FROM r""")
def run_log(spark, d):
    """Runs from their events; of 24 the newest 20 by name are kept, and every second open one is live."""
    path, k = work_dir(spark, "runs"), F.col("event_id") % 24
    name = F.concat(F.lit("run_"), F.lpad(k.cast("string"), 2, "0"))
    events = table(spark, d, "events").where("ts is not null").select(name.alias("run_id"), k.alias("k"), F.col("ts").cast("timestamp").alias("at"), F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("audio_s"), F.col("event_id").cast("string").alias("item_id"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 24 % 5 > 0), 0.25).alias("cost"), F.when(F.col("event_id") % 10 == 0, "lost").alias("error"))
    each = events.groupBy("run_id", "k").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    runs.append(each.select("run_id", F.col("first").alias("at"), F.lit("begin").alias("kind"), F.lit("schedule").alias("cause"), (F.col("k") * 10).alias("planned")), path)
    runs.finished(events, path)
    ended = each.where("k % 3 > 0").select("run_id", F.col("last").alias("at"), F.lit("end").alias("kind"), F.when(F.col("k") % 3 == 1, "Completed").otherwise("Failed").alias("status"), F.when(F.col("k") % 3 == 2, "stopped").alias("error"))
    runs.append(ended, path)
    runs.rotate(spark, path)
    live = each.where("k % 2 = 0").select("run_id")
    return runs.recent(spark, path, live).select("run_id", "status", "planned", "items", "failed", r6("minutes", 4), F.col("cost").cast("double").alias("cost"), "error")


@query(f"WITH {sql.D1}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, cue_idx) AS k FROM d1) SELECT '/' || track_id || '.srt' AS path, octet_length(encode(string_agg(k || chr(13) || chr(10) || {sql.stamp('start_s')} || ' --> ' || {sql.stamp('end_s')} || chr(13) || chr(10) || regexp_replace(text, '\\r?\\n', chr(13) || chr(10), 'g') || chr(13) || chr(10), chr(13) || chr(10) ORDER BY k))) AS bytes FROM n WHERE track_id % 3 > 0 GROUP BY track_id")
def files_due(spark, d):
    """Files that were never checked or have another version than then, by a listing alone."""
    root, t = work_dir(spark, "versions"), F.col("track_id")
    texts = cue_ops.srt_text(derived.cues(spark, d)).withColumn("path", F.concat(F.lit(f"{root.removeprefix('file://')}/"), t.cast("string"), F.lit(".srt")))
    files.apply_edits(texts.select("path", F.col("srt").alias("content")), work_dir(spark, "log"), [])
    now = inventory.listed_files(spark, root, "*.srt")
    items = texts.select(t.alias("item_id"), "path")
    # of three files one is as it was, one has changed, one is new
    stored = items.join(now.select("path", "version"), "path").where("item_id % 3 <> 2").select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("version")).otherwise("1-1").alias("version"))
    found = inventory.due(spark, items, root, stored, "*.srt")
    return found.join(now.select("path", "bytes"), "path").select(_inside(root).alias("path"), "bytes")


_SEEN_SQL = "v AS (SELECT user_id AS item_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 864e9) AS INTEGER) AS part, ts, event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS version FROM events WHERE ts IS NOT NULL), l AS (SELECT item_id, part, arg_max(version, (ts, version)) AS version FROM v GROUP BY item_id, part)"


@query(f"WITH {_SEEN_SQL}, p AS (SELECT *, lag(version) OVER (PARTITION BY item_id ORDER BY part) AS was FROM l) SELECT item_id, version, CASE WHEN was IS NULL THEN 'new' ELSE 'changed' END AS change, count(*) AS n FROM p WHERE was IS NULL OR (was <> '' AND was <> version) GROUP BY ALL")
def changed_stream(spark, d):
    """Sightings of ten days each as what a stream finds when it starts again; what is new or changed, by state."""
    dealt, source, out, place = (work_dir(spark, x) for x in ("dealt", "sightings", "changed", "checkpoint"))
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(864e9)
    seen = table(spark, d, "events").where("ts is not null").select(F.col("user_id").alias("item_id"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("version"), F.col("ts").cast("timestamp").alias("seen_at"), F.floor(day).cast("int").alias("part"))
    seen.write.partitionBy("part").parquet(dealt)  # a part for ten days, by one pass
    parts, fields = spark.read.schema(seen.schema).parquet(dealt), "item_id long, version string, seen_at timestamp"
    for part in sorted(r["part"] for r in parts.select("part").distinct().collect()) or [0]:
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        recheck.write_changed(spark.readStream.schema(fields).parquet(source), out, place, delay="3650 days").awaitTermination()
    return spark.read.parquet(out).groupBy("item_id", "version", "change").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT event_id AS item_id, epoch_us(ts) AS checked_at FROM events WHERE ts IS NOT NULL) SELECT * FROM (SELECT 'all' AS asked, item_id FROM s ORDER BY checked_at DESC, item_id DESC LIMIT 2000) UNION ALL SELECT * FROM (SELECT 'one', item_id FROM s ORDER BY checked_at DESC, item_id DESC LIMIT 1)")
def report_listing(spark, d):
    """The newest reports; a limit is kept between 1 and 2000."""
    rows = table(spark, d, "events").where("ts is not null").select(F.col("event_id").alias("item_id"), F.col("ts").alias("checked_at"))
    return library.listed(rows, 9_000_000).select(F.lit("all").alias("asked"), "item_id").unionByName(library.listed(rows, -3).select(F.lit("one").alias("asked"), "item_id"))


@query("SELECT 'run_' || event_id || '.json' AS name FROM events ORDER BY name DESC LIMIT 20")
def log_retention(spark, d):
    return reports.retained(table(spark, d, "events").select(F.concat(F.lit("run_"), F.col("event_id").cast("string"), F.lit(".json")).alias("name")), "name")


# each event of a run in turn: held and spent before it, and after it
_HELD_SQL = """e AS (SELECT user_id % 20 AS run_id, event_id, CAST(greatest(value, 0) AS DOUBLE) AS v, event_id % 3 = 0 AS settles, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
  f(run_id, k, event_id, settles, h0, s0, admitted, h, s) AS (SELECT run_id, k, event_id, settles, 0e0, 0e0, TRUE, CASE WHEN settles THEN 0e0 ELSE 20e0 END, CASE WHEN settles THEN v ELSE 0e0 END FROM e WHERE k = 1 UNION ALL
    SELECT e.run_id, e.k, e.event_id, e.settles, f.h, f.s, f.h + f.s < 900, CASE WHEN e.settles THEN greatest(f.h - 20, 0) WHEN f.h + f.s < 900 THEN f.h + 20 ELSE f.h END, CASE WHEN e.settles THEN f.s + e.v ELSE f.s END FROM f JOIN e ON e.run_id = f.run_id AND e.k = f.k + 1)"""


@query(f"WITH RECURSIVE {_HELD_SQL} SELECT run_id, event_id, round(h0, 3) AS held_before, round(s0, 3) AS spent_before, admitted FROM f WHERE NOT settles")
def run_reserved(spark, d):
    events = _runs(spark, d).withColumns({"estimate_s": F.lit(20.0), "actual_s": F.when(F.col("event_id") % 3 == 0, F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))})
    done = reports.reserved(events, 900.0, "run_id", ["at_s", "event_id"])
    return done.select("run_id", "event_id", r6("held_before", 3), r6("spent_before", 3), "admitted")


@query(f"WITH {sql.TRACKS} SELECT item_id, track_idx, CASE verdict WHEN 'InSync' THEN 'in sync' WHEN 'Offset' THEN printf('%.1f', o) || 's late' WHEN 'Drifting' THEN printf('%.1f', o) || 's late, drifting' WHEN 'WrongLanguage' THEN 'the text is not the language the track claims' WHEN 'NoDialogue' THEN 'no dialogue to check' ELSE 'no conclusion' END AS said FROM (SELECT item_id, track_idx, CASE WHEN skipped IS NOT NULL THEN 'NoDialogue' WHEN toxic = 1 THEN 'WrongLanguage' ELSE verdict END AS verdict, (cue_count % 40) / 4e0 + 0.03e0 AS o FROM tracks)")
def verdict_texts(spark, d):
    verdict = reports.track_verdict(F.col("skipped"), F.col("toxic") == 1, F.lit(1), F.col("verdict"))
    return derived.tracks(spark, d).select("item_id", "track_idx", sync.verdict_text(verdict, F.col("cue_count") % 40 / 4.0 + 0.03).alias("said"))


@query(f"WITH p AS (SELECT doc_id, lang, [{', '.join(map(sql.q, _TAGS))}][doc_id % {len(_TAGS)} + 1] AS other FROM documents) SELECT doc_id, {sql.normalized('lang')} <> '' AND {sql.normalized('lang')} = {sql.normalized('other')} AS same FROM p")
def same_languages(spark, d):
    """The documents' languages against tags of all kinds."""
    other = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("doc_id") % len(_TAGS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", language.same_language(F.col("lang"), other).alias("same"))


@query(f"SELECT doc_id, name || ' (' || CAST(round_even(n_chars % 1000 / 1000e0 * 100, 0) AS INTEGER) || '%)' AS said FROM (SELECT *, MAP {{{', '.join(f'{sql.q(a)}: {sql.q(b)}' for a, b in language.NAMES.items())}}}[lang] AS name FROM documents)")
def guess_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", language.described(F.col("lang"), F.col("n_chars") % 1000 / 1000.0).alias("said"))


@query(f"WITH f AS ({_FILE_SQL}), p AS (SELECT doc_id, name, string_split(lower(regexp_replace(name, '\\.[^.]*$', '')), '.') AS parts FROM f) SELECT doc_id, name, list_contains(parts, 'cicada') OR list_contains(parts, 'cicada-heard') AS ours FROM p")
def our_files(spark, d):
    return _files(spark, d).select("doc_id", "name", naming.is_ours(F.col("name"), "cicada", "cicada-heard").alias("ours"))


@query("SELECT url, '-nostdin -hide_banner -nostats -loglevel info -i \"' || url || '\" -map 0:' || page_id % 3 || ' -vn -sn -dn -ac 1 -ar 16000 -af \"highpass=f=200,lowpass=f=3000,silencedetect=noise=-30dB:d=0.3\" -f null -' AS command FROM pages")
def detect_command(spark, d):
    return table(spark, d, "pages").select("url", commands.detect_arguments(F.col("url"), F.col("page_id") % 3).alias("command"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN lang = 'en' THEN 'en;fr' WHEN lang = 'fr' THEN 'fr;en' ELSE lang || ';en;fr' END WHEN 1 THEN CASE WHEN lang = 'de' THEN 'de' ELSE 'de;' || lang END WHEN 2 THEN '' ELSE CASE WHEN lang = 'pt' THEN 'pt;xx' ELSE 'pt;xx;' || lang END END AS codes FROM documents")
def wanted_setting(spark, d):
    """Settings that name the document's language among others, in several spellings."""
    lang = F.col("lang")
    cases = [F.concat(lang, F.lit(", English;fre; en")), F.concat(F.lit(" ger ,, de-AT;"), lang), F.lit(" ;, "), F.concat(F.lit("pt-BR;xx,"), F.upper(lang))]
    return table(spark, d, "documents").select("doc_id", F.array_join(language_list(F.element_at(F.array(*cases), (F.col("doc_id") % 4 + 1).cast("int"))), ";").alias("codes"))


@query("SELECT page_id, CASE WHEN page_id % 4 > 0 THEN CAST(length(url) AS VARCHAR) END AS body, CASE WHEN page_id % 4 = 0 THEN 'ValueError: no answer' END AS error FROM pages")
def transcriber_calls(spark, d):
    """A service that fails for every fourth clip."""

    def call(data: bytes) -> str:
        number, url = bytes(data).decode().split(" ", 1)
        if int(number) % 4 == 0:
            raise ValueError("no answer")
        return str(len(url))

    clips = table(spark, d, "pages").select("page_id", F.encode(F.concat_ws(" ", F.col("page_id").cast("string"), "url"), "UTF-8").alias("audio"))
    return transcripts.transcribed(clips, "page_id", call)


@query(f"WITH {sql.D1}, t AS (SELECT track_id, track_id % 7 * 10e0 AS moved FROM (SELECT DISTINCT track_id FROM d1)) SELECT d1.track_id, CAST(row_number() OVER (PARTITION BY d1.track_id ORDER BY cue_idx) - 1 AS INTEGER) AS seg_idx, cue_idx + moved AS start_s, cue_idx + 0.9e0 + moved AS end_s FROM d1 JOIN t USING (track_id) WHERE regexp_matches(text, '\\S')")
def segments_rebased(spark, d):
    segment = F.struct(F.col("cue_idx").alias("start"), (F.col("cue_idx") + 0.9).alias("end"), "text")
    bodies = derived.cues(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    bodies = bodies.select("track_id", F.to_json(F.struct(F.lit("x").alias("text"), "segments")).alias("body"), F.lit(600.0).alias("duration_s"))
    results = transcripts.verbose_json(bodies, "track_id").withColumn("from_s", F.col("track_id") % 7 * 10.0)
    return transcripts.segment_rows(results, "track_id", "from_s").select("track_id", "seg_idx", r6("start_s"), r6("end_s"))


@query(f"""WITH {sql.D2}, l AS (SELECT item_id, max(end_s) AS last FROM d2 GROUP BY item_id) SELECT item_id, CAST(0 AS INTEGER) AS span_idx, 0e0 AS start_s, 1.5e0 AS end_s FROM l UNION ALL SELECT item_id, 1, 4e0, round(10 + last, 3) FROM l""")
def silence_unknown_duration(spark, d):
    """Logs of films whose duration is not known: that of the log stands for it."""
    ends = derived.speech(spark, d).groupBy("item_id").agg(F.max("end_s").alias("last"))
    log = F.concat(F.lit("silence_start: 1.5\nsilence_end: 4 | x\nsilence_start: "), F.format_string("%.3f", F.round(F.col("last") + 10, 3)))
    return silences.speech(ends.select("item_id", log.alias("log"), F.lit(None).cast("double").alias("duration_s")))


@query(f"WITH {sql.D1} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) - 1 AS INTEGER) AS seg_idx, CAST(cue_idx AS DOUBLE) AS start_s, cue_idx + 0.9e0 AS end_s, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, NULL AS error FROM d1 WHERE regexp_matches(text, '\\S') AND track_id % 5 > 0 UNION ALL SELECT DISTINCT track_id, -1, NULL, NULL, NULL, 'ValueError: no answer' FROM d1 WHERE track_id % 5 = 0")
def heard_segments(spark, d):
    """A service as a table function in SQL, over clips of which it fails for every fifth."""

    def connect():
        def call(data: bytes) -> str:
            number, body = data.decode().split(" ", 1)
            if int(number) % 5 == 0:
                raise ValueError("no answer")
            return body

        return call

    providers.provide(spark, "cuewright_heard", connect)
    segment = F.struct(F.col("cue_idx").alias("start"), (F.col("cue_idx") + 0.9).alias("end"), "text")
    bodies = derived.cues(spark, d).groupBy("track_id").agg(F.to_json(F.struct(F.lit("x").alias("text"), F.array_sort(F.collect_list(segment)).alias("segments"))).alias("body"))
    clips = bodies.select("track_id", F.encode(F.concat_ws(" ", F.col("track_id").cast("string"), "body"), "UTF-8").alias("audio"), F.lit(600.0).alias("duration_s"))
    found = spark.sql("SELECT c.track_id, h.seg_idx, h.start_s, h.end_s, h.text, h.error FROM {clips} c, LATERAL cuewright_heard(c.audio, c.duration_s) h", clips=clips)
    return found.select("track_id", F.coalesce("seg_idx", F.lit(-1)).alias("seg_idx"), r6("start_s"), r6("end_s"), "text", "error")
