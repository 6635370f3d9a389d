"""The queries in DuckDB SQL, over the same derivations."""

from __future__ import annotations

from cuewright.functions.language import BOOST, CONTRADICTION, NAMES, PROFILES, SCRIPTS, SIGNATURES, THREE_TO_TWO
from cuewright.operators.signals import frame_rates
from cuewright.plans.derived import CASES, PARAGRAPHS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[''’‘´]', '', 'g'), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')"


def normalized(x: str) -> str:
    names = {v.lower(): k for k, v in NAMES.items()}
    table = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in (THREE_TO_TWO | names).items()) + "}"
    low = f"lower(regexp_replace(trim(coalesce({x}, '')), '^([^-_]+)[-_].*$', '\\1'))"
    return f"(CASE WHEN length({low}) = 2 THEN {low} ELSE coalesce({table}[{low}], {low}) END)"


# fixed value: the phrases of credits, as a pattern
_CREDITS = r"opensubtitles|subscene|addic7ed|yify|subtitles by|subtitled by|sync by|synced by|corrected by|resync|translated by|www\.|http://|https://|@gmail|subs by|encoded by|ripped by|explosiveskull"
# any white space, as RE2 writes it
BLANK = r"[\t-\r\x{85}\p{Z}]"


def clean(x: str) -> str:
    t = f"coalesce({x}, '')"
    for p in ("<[^>]*>", r"\{[^}]*\}", r"[\[(][^\])]*[\])]"):
        t = f"regexp_replace({t}, {q(p)}, ' ', 'g')"
    spoken = f"replace(replace({t}, '♪', ' '), '♫', ' ')"
    spoken = f"regexp_replace({spoken}, {q('^' + BLANK + '*[-–—]?' + BLANK + r'*[\p{Lu}][\p{Lu}\p{Nd} .' + chr(39) + r'#\-]{1,24}:' + BLANK + '*')}, '')"
    spoken = f"regexp_replace({spoken}, '^[-–— ]+', '')"
    spoken = f"regexp_replace(regexp_replace({spoken}, '{BLANK}{{2,}}', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g')"
    return f"(CASE WHEN {credits(x)} OR {music(t)} OR NOT regexp_matches({spoken}, '\\p{{L}}') THEN '' ELSE {spoken} END)"


def credits(x: str) -> str:
    return "regexp_matches(lower(coalesce(" + x + ", '')), " + q(_CREDITS) + ")"


def music(x: str) -> str:
    inner = f"regexp_replace(replace(replace(coalesce({x}, ''), '♪', ' '), '♫', ' '), '^{BLANK}+|{BLANK}+$', '', 'g')"
    return f"(length({inner}) BETWEEN 1 AND 40 AND regexp_matches(lower({inner}), {q('music|theme|song plays|instrumental|singing|humming')}))"


def stamp(s: str) -> str:
    ms = f"CAST(floor(round(({s}) * 1000, 3)) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


D1 = "d1 AS (SELECT conv_id AS track_id, CAST(turn AS INTEGER) AS cue_idx, CAST(600 + 3 * turn AS DOUBLE) AS start_s, CAST(600 + 3 * turn AS DOUBLE) + 1.5 AS end_s, text FROM conversations)"
D2 = """d2 AS (SELECT user_id % (SELECT greatest(1, count(*) // 1250) FROM events WHERE ts IS NOT NULL) AS item_id, event_id, s AS start_s, s + 0.8 + (v - floor(v)) * 3.2 AS end_s
  FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 600e6 AS s, coalesce(value, 0) AS v FROM events WHERE ts IS NOT NULL))"""


def d3(off: float, scale: float) -> str:
    o, s = f"CAST({off!r} AS DOUBLE)", f"CAST({scale!r} AS DOUBLE)"
    return f"d3 AS (SELECT item_id, event_id, {o} + {s} * (start_s - (0.05e0 + (event_id % 26) / 100e0)) AS start_s, {o} + {s} * (end_s + (0.1e0 + (event_id % 51) / 100e0)) AS end_s FROM d2 WHERE event_id % 20 <> 0)"


D5 = f"""d5 AS (SELECT CAST(n_nationkey * 100 + case_id AS INTEGER) AS case_key, 600e0 * (i + 1) AS at_s,
    off + n_nationkey / 1000e0 + (scale - 1) * (600e0 * (i + 1)) + CASE WHEN n_nationkey % 4 = 3 THEN ((i * 7 + n_nationkey) % 5) * 2.5e0 ELSE 0 END AS offset_s,
    CASE WHEN case_id = 4 AND i % 2 = 0 THEN 0.1e0 ELSE 0.8e0 END AS confidence
  FROM nation, (VALUES {', '.join(f'({a}, CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE), {n})' for a, b, c, n in CASES)}) v(case_id, off, scale, n), range(6) r(i) WHERE i < n)"""
TRACKS = """tracks AS (SELECT doc_id // 4 AS item_id, CAST(doc_id % 4 AS INTEGER) AS track_idx, lang AS language, ['InSync', 'Offset', 'Drifting', 'Mismatched', 'Unknown', 'InSync'][doc_id % 6 + 1] AS verdict,
    CAST(n_chars % 900 AS INTEGER) AS cue_count, doc_id % 7 = 0 AS hearing_impaired, doc_id % 3 = 1 AS external, CASE WHEN coalesce(quality, 1) = 0 THEN 'not read' END AS skipped, source, coalesce(toxic, 0) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""
WANTED = "('en'), ('fr'), ('it')"


def bins(source: str, width: str, start: str = "start_s", end: str = "end_s") -> str:
    first = f"CAST(floor(greatest({start}, 0) / {width}) AS BIGINT)"
    return f"(SELECT DISTINCT item_id, unnest(range({first}, greatest(CAST(ceil(greatest({end}, 0) / {width}) AS BIGINT), {first} + 1))) AS bin FROM {source})"


TEXTS = f"(SELECT doc_id, text, lang FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({-k}, {q(t)}, {q(lang)})' for k, lang, t in PARAGRAPHS)}) p(doc_id, text, lang))"


def script(x: str) -> str:
    blocks = " ".join(f"WHEN len(list_filter(regexp_extract_all({x}, {q(b)}), lambda c: regexp_matches(c, '\\p{{L}}'))) > len(regexp_extract_all({x}, '\\p{{L}}')) // 10 THEN {q(c)}" for c, b in SCRIPTS)
    return f"(CASE WHEN len(regexp_extract_all({x}, '\\p{{L}}')) < 20 THEN NULL {blocks} END)"


IDENT = f"""profile AS (SELECT code, ({words('marker')})[1] AS word FROM (VALUES {', '.join(f'({q(c)}, {q(w)})' for c, l in PROFILES.items() for w in l)}) p(code, marker)),
  letters AS (SELECT * FROM (VALUES {', '.join(f'({q(c)}, {q("[" + "".join(s) + "]")})' for c, s in SIGNATURES.items())}) s(code, pattern)),
  base AS (SELECT doc_id, lang, lower(text) AS low, {words('text')} AS w, {script('text')} AS script FROM {TEXTS}),
  hits AS (SELECT doc_id, code, n, count(*) AS h, any_value(low) AS low FROM (SELECT doc_id, len(w) AS n, low, unnest(w) AS word FROM base WHERE len(w) >= 40 AND script IS NULL) JOIN profile USING (word) GROUP BY doc_id, code, n),
  scores AS (SELECT doc_id, hits.code, h / n * CASE WHEN regexp_matches(low, pattern) THEN {BOOST}e0 ELSE 1e0 END AS score FROM hits LEFT JOIN letters USING (code) UNION ALL SELECT doc_id, script, 1 FROM base WHERE script IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rank FROM scores)"""

CONTRA = f"""contra AS (SELECT b.doc_id, b.lang, max(CASE WHEN rank = 1 THEN r.code END) AS top_code, max(CASE WHEN rank = 1 THEN score END) AS top_score,
    coalesce(max(CASE WHEN r.code = b.lang THEN score END), 0) AS own FROM base b LEFT JOIN ranked r ON r.doc_id = b.doc_id AND rank <= 5 GROUP BY b.doc_id, b.lang),
  judged AS (SELECT doc_id, lang AS tag, top_code, top_score, coalesce(top_code <> lang AND lang IN ({', '.join(map(q, PROFILES))}) AND top_score >= {CONTRADICTION} * own, FALSE) AS contradicted FROM contra)"""

VOTE = f"""tok AS (SELECT track_id, unnest(w) AS word, start_s + 1.5 * ((unnest(range(len(w))) + 0.5) / len(w)) AS at_s FROM (SELECT *, {words('text')} AS w FROM d1)),
  c AS (SELECT track_id, word, at_s AS c, count(*) OVER (PARTITION BY track_id, word) AS nc FROM tok WHERE length(word) >= 2),
  h AS (SELECT track_id, word, at_s - 2.5 AS h, count(*) OVER (PARTITION BY track_id, word) AS nh FROM tok WHERE length(word) >= 2),
  hist AS (SELECT track_id, CAST(round((c - h) / 0.2e0) AS INTEGER) AS bin, sum(1e0 / (nc * nh)) AS weight, count(*) AS votes FROM c JOIN h USING (track_id, word) WHERE nc <= 6 AND nh <= 6 AND abs(c - h) <= 30 GROUP BY ALL),
  smooth AS (SELECT track_id, bin + d AS bin, sum(weight * s) AS smooth FROM hist, (VALUES (-1, 0.5e0), (0, 1e0), (1, 0.5e0)) m(d, s) GROUP BY ALL)"""
PEAK = """top AS (SELECT track_id, bin AS peak, smooth AS height FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(smooth, 9) DESC, abs(bin), bin) AS r FROM smooth) WHERE r = 1),
  rival AS (SELECT track_id, bin AS rival, smooth AS rh FROM (SELECT s.*, row_number() OVER (PARTITION BY s.track_id ORDER BY round(smooth, 9) DESC, abs(bin), bin) AS r FROM smooth s JOIN top USING (track_id) WHERE abs(bin - peak) >= 10) WHERE r = 1),
  mass AS (SELECT track_id, peak, height, sum(weight) AS total, sum(CASE WHEN abs(bin - peak) <= 1 THEN weight ELSE 0 END) AS agree, sum(votes) AS votes FROM hist JOIN top USING (track_id) GROUP BY ALL)"""


def fit(snap: bool) -> str:
    rate = " ".join(f"WHEN abs(1 + slope - {s!r}) <= 0.0002 THEN {k}" for k, _, _, s, _ in frame_rates())
    table = ", ".join(f"({k}, CAST({s!r} AS DOUBLE), {q(l)})" for k, _, _, s, l in frame_rates())
    return f"""used AS (SELECT case_key, at_s AS x, offset_s AS y, confidence AS w FROM d5 WHERE confidence >= 0.15),
  centre AS (SELECT case_key, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM used GROUP BY case_key),
  line AS (SELECT case_key, sw, mx, my, n, CASE WHEN n > 1 AND sum(w * (x - mx) * (x - mx)) > 1e-9 THEN sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) ELSE 0 END AS slope FROM used JOIN centre USING (case_key) GROUP BY case_key, sw, mx, my, n),
  named AS (SELECT line.*, coalesce(ratio, 1 + slope) AS scale, label FROM (SELECT *, CASE WHEN n > 1 AND {str(snap).upper()} THEN CASE {rate} END END AS k FROM line) line LEFT JOIN (VALUES {table}) f(k, ratio, label) USING (k)),
  solved AS (SELECT *, my - (scale - 1) * mx AS b FROM named),
  fit AS (SELECT case_key, b AS offset_s, scale, sqrt(sum(w * (y - (b + (scale - 1) * x)) * (y - (b + (scale - 1) * x))) / sw) AS residual_s, n AS points, label AS frame_rate FROM used JOIN solved USING (case_key) GROUP BY case_key, b, scale, sw, n, label)"""


FIT_COLUMNS = "case_key, round(offset_s, 6) AS offset_s, round(scale, 9) AS scale, round(residual_s, 6) AS residual_s, points, frame_rate"
ASSESS = """counted AS (SELECT case_key, count(*) AS anchors, count(*) FILTER (confidence >= 0.15) AS confident, avg(confidence) FILTER (confidence >= 0.15) AS mean_confidence, max(at_s) AS last_s FROM d5 GROUP BY case_key),
  errs AS (SELECT c.*, coalesce(offset_s, 0) AS o, coalesce(scale, 1) AS s, coalesce(residual_s, 0) AS r FROM counted c LEFT JOIN fit USING (case_key)),
  judged AS (SELECT *, greatest(abs(o), abs(o + (s - 1) * 5400)) AS worst, CASE WHEN confident = 0 THEN 'Mismatched' WHEN confident = 1 AND abs(o) <= 0.35 THEN 'InSync' WHEN confident = 1 THEN 'Offset' WHEN confident = 2 THEN 'Unknown'
      WHEN r > 1.5 THEN 'Mismatched' WHEN greatest(abs(o), abs(o + (s - 1) * 5400)) <= 0.35 THEN 'InSync' WHEN abs((s - 1) * 5400) > 0.35 THEN 'Drifting' ELSE 'Offset' END AS verdict FROM errs),
  done AS (SELECT case_key, anchors, confident, mean_confidence, verdict, CASE WHEN confident = 0 THEN 0 WHEN confident <= 2 OR r > 1.5 THEN abs(o) ELSE worst END AS worst_s, verdict IN ('Offset', 'Drifting') AS repairable FROM judged)"""

CURVE = f"""a AS {bins('d2', '0.2e0')}, c AS {bins('d3', '0.2e0')},
  ends AS (SELECT * FROM (SELECT item_id, min(bin) AS fa, max(bin) AS la FROM a GROUP BY item_id) JOIN (SELECT item_id, min(bin) AS fc, max(bin) AS lc FROM c GROUP BY item_id) USING (item_id)),
  lags AS (SELECT item_id, lag, greatest(fc, fa + lag) AS lo, least(lc, la + lag) AS hi FROM ends, range(-75, 76) r(lag)),
  met AS (SELECT a.item_id, c.bin - a.bin AS lag, count(*) AS b FROM a JOIN c ON a.item_id = c.item_id AND c.bin BETWEEN a.bin - 75 AND a.bin + 75 GROUP BY ALL),
  sc AS (SELECT l.item_id, lag, count(*) AS sc FROM lags l JOIN c ON c.item_id = l.item_id AND c.bin BETWEEN lo AND hi GROUP BY ALL),
  sa AS (SELECT l.item_id, lag, count(*) AS sa FROM lags l JOIN a ON a.item_id = l.item_id AND a.bin + lag BETWEEN lo AND hi GROUP BY ALL),
  sums AS (SELECT item_id, lag, CAST(hi - lo + 1 AS DOUBLE) AS n, coalesce(sa, 0) AS sa, coalesce(sc, 0) AS sc, coalesce(b, 0) AS b FROM lags LEFT JOIN met USING (item_id, lag) LEFT JOIN sc USING (item_id, lag) LEFT JOIN sa USING (item_id, lag)),
  curve AS (SELECT item_id, lag, CASE WHEN n < 16 OR sa = 0 OR sc = 0 OR sa >= n OR sc >= n THEN 0 ELSE (n * b - sa * sc) / (sqrt(n * sa - sa * sa) * sqrt(n * sc - sc * sc)) END AS score FROM sums),
  best AS (SELECT item_id, lag AS peak, score AS top FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lag) AS r FROM curve) WHERE r = 1 AND score > 0)"""

COVER = f"""best AS (SELECT * FROM (SELECT *, {normalized('language')} AS lang2, row_number() OVER (PARTITION BY item_id, {normalized('language')} ORDER BY CASE verdict WHEN 'InSync' THEN 4 WHEN 'Offset' THEN 3 WHEN 'Drifting' THEN 2 WHEN 'Unknown' THEN 1 ELSE 0 END DESC, cue_count DESC, hearing_impaired, external, track_idx) AS r FROM tracks WHERE skipped IS NULL AND {normalized('language')} <> '') WHERE r = 1),
  wanted AS (SELECT item_id, lang FROM (SELECT DISTINCT item_id FROM tracks), (VALUES {WANTED}) w(lang)),
  covered AS (SELECT w.item_id, w.lang, verdict FROM wanted w LEFT JOIN best b ON b.item_id = w.item_id AND b.lang2 = w.lang)"""

SAID = f"""said AS (SELECT track_id, CAST(cue_idx * 10000 + g AS INTEGER) AS cue_idx, min(said_at) AS start_s, max(said_at) AS end_s, string_agg(word, ' ' ORDER BY i) || CASE WHEN g % 3 = 2 THEN '.' ELSE '' END AS text
    FROM (SELECT track_id, cue_idx, i, i // 6 AS g, w[i + 1] AS word, start_s + 1.5 * ((i + 0.5) / len(w)) AS said_at FROM (SELECT *, unnest(range(len(w))) AS i FROM (SELECT *, {words('text')} AS w FROM d1))) GROUP BY track_id, cue_idx, g)"""
# segments joined one after the other
JOINED = """seg AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, cue_idx, end_s, text) AS k FROM said),
  walk(track_id, k, g, a, b, t) AS (SELECT track_id, k, 0, start_s, end_s, text FROM seg WHERE k = 1 UNION ALL
    SELECT track_id, k, g + CASE WHEN joins THEN 0 ELSE 1 END, CASE WHEN joins THEN a ELSE start_s END, end_s, CASE WHEN joins THEN t || ' ' || text ELSE text END
    FROM (SELECT s.*, w.g, w.a, w.t, s.start_s - w.b <= 0.35 AND NOT regexp_matches(w.t, '[.!?。！？]$') AND length(w.t) + 1 + length(s.text) <= 84 AND s.end_s - w.a <= 7 AS joins FROM walk w JOIN seg s ON s.track_id = w.track_id AND s.k = w.k + 1)),
  joined AS (SELECT track_id, g AS seg_idx, max_by(a, k) AS start_s, max_by(b, k) AS end_s, max_by(t, k) AS text FROM walk GROUP BY track_id, g)"""
# lines cut word by word, then timed by their characters
SPLIT = """long AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM joined WHERE length(text) > 84 OR end_s - start_s > 7),
  cut(track_id, seg_idx, i, p, line, done) AS (SELECT track_id, seg_idx, 0, 0, '', FALSE FROM long UNION ALL
    SELECT track_id, seg_idx, i + 1, CASE WHEN done THEN p + 1 ELSE p END, line2, length(line2) >= 84 OR regexp_matches(word, '[.!?。！？]$') OR (ends_with(word, ',') AND length(line2) > 42)
    FROM (SELECT c.*, l.w[c.i + 1] AS word, CASE WHEN c.done OR c.line = '' THEN l.w[c.i + 1] ELSE c.line || ' ' || l.w[c.i + 1] END AS line2 FROM cut c JOIN long l USING (track_id, seg_idx) WHERE c.i < len(l.w))),
  pieces AS (SELECT track_id, seg_idx, CAST(p AS INTEGER) AS piece_idx, max_by(line, i) AS piece FROM cut WHERE i > 0 GROUP BY ALL UNION ALL SELECT track_id, seg_idx, 0, text FROM joined WHERE length(text) <= 84 AND end_s - start_s <= 7),
  timed AS (SELECT p.*, j.start_s AS a, j.end_s - j.start_s AS long_s, sum(length(piece)) OVER (PARTITION BY track_id, seg_idx) AS total, coalesce(sum(length(piece)) OVER (PARTITION BY track_id, seg_idx ORDER BY piece_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM pieces p JOIN joined j USING (track_id, seg_idx)),
  parts AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx, piece_idx) - 1 AS cue_idx, greatest(a + long_s * upto / total, 0) AS start_s, a + long_s * (upto + length(piece)) / total AS e, piece FROM timed),
  tidy AS (SELECT *, least(start_s + least(greatest(e - start_s, 1), 7), coalesce(lead(start_s) OVER (PARTITION BY track_id ORDER BY start_s, cue_idx), 1e300)) AS end_s FROM parts)"""


def wrap(x: str) -> str:
    blanks = f"list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) = ' ')"
    cut = f"(list_min(list_transform({blanks}, lambda i: abs(i - 1 - length({x}) // 2) * 1000000 + i)) % 1000000)"
    return f"CASE WHEN length({x}) > 42 AND len({blanks}) > 0 THEN substr({x}, 1, {cut} - 1) || chr(10) || substr({x}, {cut} + 1) ELSE {x} END"
