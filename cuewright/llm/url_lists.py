"""Temporal list join for URL filters, in DataFrame functions alone.

A list is a log: dated entries put a domain on it or take it off. Each entry
holds from its date to the next entry of the same domain; those that put the
domain on the list become validity intervals. A capture is matched as of the
time it was fetched with the intervals of its host and of every domain above.

Defined cases: of entries of one domain and date the one with the larger id
counts; a domain listed twice in a row keeps the date of each entry; entries
without a domain, date or id are left out; a URL without a host, a null URL and
a null fetch time match nothing and stay in the result; repeated captures stay;
an empty list blocks nothing; case does not matter; an address has no domain
above it; a closing point is part of a host, which no entry without one matches; other columns of the captures are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Intervals that are broadcast; a longer list is joined by shuffles on the domain.
BROADCAST_ROWS = 1_000_000
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#\[]+)"
#: Hosts that are addresses: no domain is above them.
ADDRESS = r"^(\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; '' without one."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and the domains above it, down to two labels; a host of one label alone."""
    labels = F.split(host, r"\.")
    more = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).when(host.rlike(ADDRESS), F.array(host)).otherwise(more)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, listed_at, until) of a log (entry_id, domain, at, listed): half-open, until null where nothing follows."""
    rows = entries.where("domain is not null and at is not null and entry_id is not null").withColumn("domain", F.lower("domain"))
    order = Window.partitionBy("domain").orderBy("at", "entry_id")
    rows = rows.withColumn("until", F.lead("at").over(order)).where("listed and (until is null or until > at)")
    return rows.select("domain", F.col("at").alias("listed_at"), "until")


def match_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(key, host, fetched, blocked, domain, listed_at): each capture with the longest domain listed when it was fetched."""
    spans = intervals(entries)
    rows = captures.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), F.col(fetched).alias(fetched))
    asked = rows.withColumn("domain", F.explode_outer(domains_of(F.col("host"))))
    small = spans.count() <= BROADCAST_ROWS
    spans = F.broadcast(spans) if small else spans
    live = (asked["domain"] == spans["domain"]) & (asked[fetched] >= spans["listed_at"]) & (spans["until"].isNull() | (asked[fetched] < spans["until"]))
    best = F.struct(F.length(spans["domain"]).alias("n"), spans["domain"].alias("domain"), spans["listed_at"].alias("listed_at"))
    joined = asked.join(spans, live, "left").select(asked[key], asked["host"], asked[fetched], F.when(spans["domain"].isNotNull(), best).alias("m"), F.when(asked["domain"].isNull() | (asked["domain"] == asked["host"]), 1).alias("one"))
    # equal captures have equal answers: they are counted, matched once and given out again
    found = joined.groupBy(key, "host", fetched).agg(F.max("m").alias("m"), F.sum("one").alias("copies"))
    found = found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(key, "host", fetched, F.col("m").isNotNull().alias("blocked"), F.col("m.domain").alias("domain"), F.col("m.listed_at").alias("listed_at"))


#: The query's list and times are derived from the pages: seconds from 2024-01-01, over one year.
START, DAY, YEAR = 1704067200, 86400, 31536000


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(START) + (F.col("page_id") * 7919) % 525600 * 60).alias("fetched_at"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A third of the hosts, and the registered domain of another fifth, are listed, taken off 90 days later, and some listed again."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5(F.encode("host", "UTF-8")), 1, 6), 16, 10).cast("long"))
    own = (F.col("h") % 3 == 0) | (F.size(F.split("host", r"\.")) <= 2)
    listed = hosts.where("h % 3 = 0 or h % 5 = 1").select(F.when(own, F.col("host")).otherwise(F.regexp_replace("host", r"^[^.]*\.", "")).alias("domain"), "h")
    first = F.lit(START) + F.col("h") % 250 * DAY
    log = lambda k, days, on: listed.where(F.col("h") % k == 0).select((F.col("h") * 4 + days % 4).alias("entry_id"), "domain", (first + days * DAY).alias("at"), F.lit(on).alias("listed"))
    return log(1, 0, True).unionByName(log(1, 90, False)).unionByName(log(2, 121, True)).distinct()


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active when it was fetched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return match_captures(derived_captures(pages), derived_list(pages))


OP8_SQL = r"""
WITH caps AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#\[]+)', 1), '') AS host,
         1704067200 + (page_id * 7919) % 525600 * 60 AS fetched_at
  FROM pages),
hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT host FROM caps WHERE host <> '')),
listed AS (
  SELECT CASE WHEN h % 3 = 0 OR len(string_split(host, '.')) <= 2 THEN host ELSE regexp_replace(host, '^[^.]*\.', '') END AS domain,
         h, 1704067200 + h % 250 * 86400 AS first_at
  FROM hosts WHERE h % 3 = 0 OR h % 5 = 1),
log AS (
  SELECT h * 4 AS entry_id, domain, first_at AS stamp, TRUE AS listed FROM listed
  UNION SELECT h * 4 + 2, domain, first_at + 90 * 86400, FALSE FROM listed
  UNION SELECT h * 4 + 1, domain, first_at + 121 * 86400, TRUE FROM listed WHERE h % 2 = 0),
spans AS (
  SELECT * FROM (SELECT domain, stamp AS listed_at, lead(stamp) OVER (PARTITION BY domain ORDER BY stamp, entry_id) AS until, listed FROM log)
  WHERE listed AND (until IS NULL OR until > listed_at)),
asked AS (
  SELECT page_id, fetched_at, array_to_string(labels[i:], '.') AS domain
  FROM (SELECT page_id, fetched_at, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i
        FROM (SELECT page_id, fetched_at, CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$') THEN [host] ELSE string_split(host, '.') END AS labels FROM caps WHERE host <> ''))),
best AS (
  SELECT page_id, s.domain, listed_at, row_number() OVER (PARTITION BY page_id ORDER BY length(s.domain) DESC) AS k
  FROM asked a JOIN spans s ON a.domain = s.domain AND fetched_at >= listed_at AND (until IS NULL OR fetched_at < until))
SELECT c.page_id, host, fetched_at, b.domain IS NOT NULL AS blocked, b.domain, listed_at
FROM caps c LEFT JOIN best b ON c.page_id = b.page_id AND b.k = 1
"""
