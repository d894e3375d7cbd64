"""Queries over the robots.txt files of all origins in the pages table.

What an origin's robots.txt answers follows from its first page's number modulo 8: a file, a file behind
one redirect or behind five on another host, a sixth redirect, a loop, a bad target, nothing, or an error.
Its rules are made of the starts and ends of its pages' paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import url
from skein.operators import robots_table
from skein.operators.queries import _ORIGIN, _PATH, _t, query
from skein.sources.staging import staged

TOKEN = "skein"


def _origins(pages: DataFrame) -> DataFrame:
    return staged(pages.groupBy(url.origin(F.col("url")).alias("origin")).agg(F.min("page_id").alias("lo")).where("origin IS NOT NULL"), "origins")


def _files(pages: DataFrame, origins: DataFrame) -> DataFrame:
    """Each origin's file: rules of a few characters, so that there are few different ones."""
    path, n = url.path(F.col("url")), F.col("page_id")
    rule = F.array(
        F.when(n % 3 == 0, F.concat(F.lit("Disallow: "), F.substr(path, F.lit(1), F.lit(5)))),
        F.when(n % 5 == 0, F.concat(F.lit("Allow: "), F.substr(path, F.lit(1), F.lit(7)))),
        F.when(n % 7 == 0, F.concat(F.lit("Disallow: /*"), F.right(path, F.lit(2)), F.lit("$"))),
    )
    lines = pages.select(url.origin(F.col("url")).alias("origin"), F.explode(rule).alias("line")).where("line IS NOT NULL").distinct()
    bodies = lines.groupBy("origin").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    head = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: SKEIN/2\nUser-agent: *\nCrawl-delay: "), F.col("lo") % 17, F.lit("\n"))
    return origins.join(bodies, "origin", "left").select("origin", "lo", F.concat(head, F.coalesce("lines", F.lit(""))).alias("body"))


def answers(pages: DataFrame, origins: DataFrame) -> DataFrame:
    """url, status_code, location, error_kind, body, attempts, answered: every answer, older ones too."""
    o, lo, kind = F.col("origin"), F.col("lo"), F.col("lo") % 8
    none = F.lit(None).cast("string")

    def row(at, status, location=none, body=none, error=none, answered=1):
        return F.struct(at.alias("url"), F.lit(status).cast("int").alias("status_code"), location.alias("location"), error.alias("error_kind"), body.alias("body"), F.lit(1).alias("attempts"), F.lit(answered).alias("answered"))

    first = F.concat(o, F.lit("/robots.txt"))
    cdn = lambda k: F.concat(F.lit("https://cdn.test/r"), lo, F.lit(f"/{k}"))
    chain = lambda n: [row(first, 301, cdn(1)), *(row(cdn(k), 307, F.concat(F.lit(f"./{k + 1}"))) for k in range(1, n))]
    bad = F.when(lo % 3 == 0, F.lit("ftp://files.test/")).when(lo % 3 == 1, F.lit("http://u:p@h.test/robots.txt"))
    found = (
        F.when(kind == 0, F.array(row(first, 200, body=F.col("body")), row(first, 500, answered=0)))
        .when(kind == 1, F.array(row(first, 302, F.lit("/a/../rules.txt")), row(F.concat(o, F.lit("/rules.txt")), 200, body=F.col("body"))))
        .when(kind == 2, F.array(*chain(5), row(cdn(5), 200, body=F.col("body"))))
        .when(kind == 3, F.array(*chain(6), row(cdn(6), 200, body=F.col("body"))))
        .when(kind == 4, F.array(row(first, 302, F.lit("/again")), row(F.concat(o, F.lit("/again")), 303, first)))
        .when(kind == 5, F.array(row(first, 308, bad)))
        .when(kind == 6, F.array(row(first, 200, body=F.col("body"), answered=0), row(first, 410)))
        .when(lo % 2 == 1, F.array(row(first, 503)))
    )
    return _files(pages, origins).select(F.explode(found).alias("a")).select("a.*")


def _records(pages: DataFrame) -> DataFrame:
    origins = _origins(pages)
    return robots_table.records(origins, robots_table.newest(answers(pages, origins)))


#: Of each origin its first page and kind; of kind 7, whose answers are errors, first pages are odd.
_O = f"WITH g AS (SELECT page_id, url, {_ORIGIN} AS origin, {_PATH} AS path FROM pages), o AS (SELECT origin, min(page_id) AS lo, min(page_id) % 8 AS kind FROM g GROUP BY origin)"
_PARSED = "kind IN (0, 1, 2)"


@query(_O + f""" SELECT origin, CAST(CASE WHEN {_PARSED} THEN 200 WHEN kind = 6 THEN 410 WHEN kind = 7 THEN 503 END AS INT) AS status_code, CASE WHEN {_PARSED} THEN 'parsed' WHEN kind = 6 THEN 'allow-all' ELSE 'unavailable' END AS outcome,
  CASE kind WHEN 3 THEN 'redirect-limit' WHEN 4 THEN 'redirect-loop' WHEN 5 THEN 'bad-redirect' WHEN 7 THEN 'http-status' END AS error_kind,
  CAST(CASE kind WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 1 ELSE 0 END AS INT) AS hops, CAST(CASE kind WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 6 WHEN 4 THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM o""")
def q_robots_records(spark, sf_dir):
    """What the robots.txt of each of the pages' origins comes to, over redirects, in at most six joins."""
    return _records(_t(spark, sf_dir, "pages")).select("origin", "status_code", "outcome", "error_kind", "hops", "attempts")


@query(_O + f""", r AS (SELECT DISTINCT origin, allow, pattern, n FROM (
  SELECT origin, false AS allow, substr(path, 1, 5) AS pattern, length(substr(path, 1, 5)) AS n FROM g WHERE page_id % 3 = 0 UNION ALL SELECT origin, true, substr(path, 1, 7), length(substr(path, 1, 7)) FROM g WHERE page_id % 5 = 0
  UNION ALL SELECT origin, false, '*' || right(path, 2), 3 + length(right(path, 2)) FROM g WHERE page_id % 7 = 0)),
d AS (SELECT page_id, arg_max(allow, 2 * n + CAST(allow AS INT)) AS allow FROM (SELECT page_id, origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS place FROM g) p JOIN r USING (origin)
  WHERE CASE WHEN pattern LIKE '*%' THEN length(place) > length(pattern) - 1 AND ends_with(place, substr(pattern, 2)) ELSE starts_with(place, pattern) END GROUP BY page_id)
SELECT page_id, CASE WHEN kind IN (3, 4, 5, 7) THEN 'robots-unavailable' WHEN {_PARSED} AND NOT coalesce(allow, true) THEN 'robots' END AS reason FROM g JOIN o USING (origin) LEFT JOIN d USING (page_id)""")
def q_robots_by_origin(spark, sf_dir):
    """Why a page may not be fetched, by the newest robots.txt of its own origin: rules and records are joined to all pages."""
    pages = _t(spark, sf_dir, "pages")
    records = _records(pages)
    rules = robots_table.prepared(robots_table.rules(records, TOKEN))
    decided = robots_table.decide(pages.select("page_id", "url"), rules, "url").withColumn("origin", url.origin(F.col("url")))
    reason = F.when(F.col("outcome") == "unavailable", "robots-unavailable").when((F.col("outcome") == "parsed") & ~F.col("allowed"), "robots")
    return decided.join(records.select("origin", "outcome"), "origin").select("page_id", reason.alias("reason"))


@query(_O + f" SELECT origin, CAST(CASE WHEN {_PARSED} AND lo % 17 > 0 THEN least(10000, 1000 * (lo % 17)) ELSE 200 END AS BIGINT) AS gap_ms FROM o")
def q_robots_gaps(spark, sf_dir):
    """The gap that each origin's file asks for between requests."""
    records = _records(_t(spark, sf_dir, "pages"))
    return robots_table.gaps(records, robots_table.rules(records, TOKEN), 200)


@query(rf"""WITH g AS (SELECT page_id, {_ORIGIN} AS origin, {_PATH} AS path, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS place FROM pages),
r AS (SELECT origin, pattern, wild, bool_or(allow) AS allow FROM (SELECT origin, page_id % 2 = 0 AS allow, page_id % 3 = 0 AS wild, substr(path, 1, unnest(range(2, 1 + length(path)))) AS pattern FROM g) GROUP BY ALL),
m AS (SELECT place, origin, arg_max(allow, 2 * (length(pattern) + CAST(wild AS INT)) + CAST(allow AS INT)) AS allow FROM (SELECT DISTINCT origin, place FROM g) p JOIN r USING (origin) WHERE starts_with(place, pattern) GROUP BY ALL)
SELECT page_id, coalesce(allow, true) AS allowed FROM g LEFT JOIN m USING (origin, place)""")
def q_robots_many_rules(spark, sf_dir):
    """All starts of all pages' paths as rules of their origin, every third with a wildcard: many rules for each page."""
    pages = _t(spark, sf_dir, "pages")
    path, n = url.path(F.col("url")), F.col("page_id")
    lengths = F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(path)))
    rules = pages.select(url.origin(F.col("url")).alias("origin"), (n % 2 == 0).alias("allow"), path.alias("path"), (n % 3 == 0).alias("wild"), F.explode(F.filter(lengths, lambda k: k <= F.length(path))).alias("k"))
    pattern = F.concat(F.substr("path", F.lit(1), F.col("k")), F.when(F.col("wild"), "*").otherwise(""))
    rules = robots_table.prepared(rules.select("origin", "allow", pattern.alias("pattern")))
    return robots_table.decide(pages.select("page_id", "url"), rules, "url").select("page_id", "allowed")
