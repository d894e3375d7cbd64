"""Queries over crawls of the maze: redirects, declared canonicals, repeated bodies, odd links, times and reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.queries import query
from skein.plans import crawl as engine
from skein.plans import report, trace
from skein.plans.config import CrawlConfig
from skein.sources import site

M = site.MAZE


def _crawled(spark, sf_dir, *kinds: int, clock=time.time, robots=None, **config) -> engine.CrawlResult:
    settings = {"max_depth": 2, "max_pages": 10**9} | config
    return engine.crawl(spark, CrawlConfig(start_url=f"{M}/", **settings), site.maze(spark, sf_dir, kinds), robots, clock=clock)


def _verdicts(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("canonicalUrl").alias("url"), "depth", F.col("discoveredFrom").alias("parent"), F.col("finalUrl").alias("final"), "state", F.coalesce("skipReason", "errorKind").alias("reason"), F.col("errorMessage").alias("message"), F.col("statusCode").alias("status"), "attempts")


def _expected(kinds: str, cases: str) -> str:
    """A row for each customer of the kinds, and the start."""
    return f"""SELECT url, CAST(depth AS INT) AS depth, parent, final, state, reason, message, CAST(status AS INT) AS status, CAST(attempts AS INT) AS attempts FROM (
  SELECT '{M}/' AS url, 0 AS depth, NULL AS parent, '{M}/' AS final, 'ok' AS state, NULL AS reason, NULL AS message, 200 AS status, 1 AS attempts UNION ALL
  SELECT '{M}/c/' || k, 1, '{M}/', {cases} FROM (SELECT c_custkey AS k, c_custkey % 10 AS kind FROM customer) WHERE kind IN ({kinds}))"""


_LOST = "k - 4 NOT IN (SELECT c_custkey FROM customer)"


@query(_expected("0, 4", f"""CASE WHEN kind = 0 THEN '{M}/f/' || k WHEN {_LOST} THEN '{M}/c/' || (k - 4) ELSE '{M}/c/' || k END, CASE WHEN kind = 0 THEN 'ok' WHEN {_LOST} THEN 'failed' ELSE 'skipped' END,
  CASE WHEN kind = 0 THEN NULL WHEN {_LOST} THEN 'http-status' ELSE 'duplicate' END, CASE WHEN kind = 4 AND {_LOST} THEN 'HTTP 404' END, CASE WHEN kind = 0 THEN 200 WHEN {_LOST} THEN 404 ELSE 302 END, CASE WHEN kind = 0 OR {_LOST} THEN 2 ELSE 1 END"""))
def q_redirect_final(spark, sf_dir):
    """Redirects to pages of their own, and to pages that other ones own, if they are stored."""
    return _verdicts(_crawled(spark, sf_dir, 0, 4).pages)


@query(_expected("1, 3, 8", f"""'{M}/c/' || k, CASE WHEN kind = 3 THEN 'skipped' ELSE 'failed' END, CASE kind WHEN 1 THEN 'redirect-loop' WHEN 3 THEN 'redirect-off-origin' ELSE 'bad-redirect' END,
  CASE kind WHEN 1 THEN 'redirect loop' WHEN 8 THEN 'redirect is missing Location' END, 302, 1"""))
def q_redirect_loop(spark, sf_dir):
    return _verdicts(_crawled(spark, sf_dir, 1, 3, 8).pages)


@query(_expected("2", f"""'{M}/h/' || k || '/5', 'failed', 'redirect-limit', 'redirect hop limit exceeded', 302, 6"""))
def q_redirect_limit(spark, sf_dir):
    """Five redirects are followed; the sixth isn't."""
    return _verdicts(_crawled(spark, sf_dir, 2).pages)


@query(_expected("5, 6, 7", f"""'{M}/c/' || k, CASE WHEN kind = 6 THEN 'ok' ELSE 'skipped' END, CASE kind WHEN 5 THEN 'canonical' WHEN 7 THEN 'duplicate-content' END, NULL, 200, 1""")
       + f"""UNION ALL SELECT '{M}/t/' || c_custkey, 1, '{M}/c/' || c_custkey, '{M}/t/' || c_custkey, 'ok', NULL, NULL, 200, 1 FROM customer WHERE c_custkey % 10 = 5""")
def q_canonical_skip(spark, sf_dir):
    """Declared canonicals are taken at their page's depth; of two pages with one body the first is kept."""
    return _verdicts(_crawled(spark, sf_dir, 5, 6, 7).pages)


@query(_expected("5, 6, 7", f"""'{M}/c/' || k, 'ok', NULL, NULL, 200, 1"""))
def q_no_canonical_no_dedupe(spark, sf_dir):
    """The same pages with both identities switched off."""
    return _verdicts(_crawled(spark, sf_dir, 5, 6, 7, respect_canonical=False, dedupe_content=False).pages)


@query(_expected("9", f"""'{M}/c/' || k, 'ok', NULL, NULL, 200, 1""") + f"""
  UNION ALL SELECT url, 2, parent, CASE WHEN state = 'ok' THEN url END, state, reason, NULL, CASE WHEN state = 'ok' THEN 200 END, CASE WHEN state = 'ok' THEN 1 ELSE 0 END FROM (
    SELECT '{M}/c/' || c_custkey AS parent, unnest(['https://other.test/x' || c_custkey, '{M}/a/a/a/' || c_custkey, '{M}/l/' || c_custkey]) AS url, unnest(['skipped', 'skipped', 'ok']) AS state,
      unnest(['other-origin', 'repeated-segment', NULL]) AS reason FROM customer WHERE c_custkey % 10 = 9)""")
def q_odd_links(spark, sf_dir):
    """Links to another site and into a trap are skipped, with a row each."""
    return _verdicts(_crawled(spark, sf_dir, 9).pages)


@query("""SELECT depth, decision, CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 AS depth, unnest(['queued', 'other-origin', 'depth-limit', 'depth-limit']) AS decision FROM customer WHERE c_custkey % 10 = 9
  UNION ALL SELECT 2, unnest(['queued', 'queued', 'other-origin', 'repeated-segment']) FROM customer WHERE c_custkey % 10 = 9 UNION ALL SELECT unnest([1, 2]), 'queued') GROUP BY depth, decision""")
def q_admission_crawled(spark, sf_dir):
    """What the engine decides on each link, at two depths: another origin comes before depth, depth before traps."""
    both = None
    for depth in (1, 2):
        pages = _crawled(spark, sf_dir, 9, max_depth=depth).pages.select(F.lit(depth).alias("depth"), F.coalesce("skipReason", F.lit("queued")).alias("decision"))
        both = pages if both is None else both.unionByName(pages)
    return both.groupBy("depth", "decision").agg(F.count("*").alias("n"))


@query(f"""SELECT url, depth, rank <= 30 AS taken, CASE WHEN rank > 30 THEN 'page-limit' END AS reason FROM (SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS rank FROM (
  SELECT '{M}/' AS url, CAST(0 AS INT) AS depth UNION ALL SELECT '{M}/c/' || c_custkey, 1 FROM customer WHERE c_custkey % 10 = 0))""")
def q_page_limit_crawled(spark, sf_dir):
    """Thirty URLs are reserved, in the order of their keys."""
    pages = _crawled(spark, sf_dir, 0, max_pages=30).pages
    return pages.select(F.col("canonicalUrl").alias("url"), "depth", F.col("reserved").alias("taken"), F.col("skipReason").alias("reason"))


_NUMBERED = f"""SELECT url, kind, row_number() OVER (ORDER BY d, url) - 1 AS n FROM (SELECT '{M}/' AS url, 0 AS d, 9 AS kind UNION ALL SELECT '{M}/c/' || c_custkey, 1, c_custkey % 10 FROM customer WHERE c_custkey % 10 IN (0, 2))"""


@query(f"""SELECT url, CAST(n AS BIGINT) AS sequence, CAST(200 AS BIGINT) AS waited, CAST(CASE kind WHEN 0 THEN 200 WHEN 2 THEN 1000 ELSE 0 END AS BIGINT) AS duration FROM ({_NUMBERED})""")
def q_page_times(spark, sf_dir):
    """Waits and durations of one worker that starts a request every 200 ms at most; answers take no time."""
    pages = _crawled(spark, sf_dir, 0, 2).pages
    return pages.select(F.col("canonicalUrl").alias("url"), "sequence", F.col("waitedMs").alias("waited"), F.col("durationMs").alias("duration"))


@query(f"""WITH t AS (SELECT *, CASE kind WHEN 0 THEN 200 WHEN 2 THEN 1000 ELSE 0 END AS took FROM ({_NUMBERED})),
  e AS (SELECT *, 200 + coalesce(sum(took + 200) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + took AS ended FROM t)
SELECT url, CASE WHEN coalesce(max(CAST(ended >= 5000 AS INT)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'queued' WHEN kind = 2 THEN 'failed' ELSE 'ok' END AS state FROM e""")
def q_time_budget(spark, sf_dir):
    """Five seconds of one worker: the page in hand at their end is finished, the others wait."""
    return _crawled(spark, sf_dir, 0, 2, max_duration_ms=5000).pages.select(F.col("canonicalUrl").alias("url"), "state")


@query(f"""WITH p AS (SELECT 'ok' AS state, '200' AS status, 0 AS depth, '{M}/' AS url, '-' AS reason UNION ALL
    SELECT CASE WHEN c_custkey % 10 = 1 THEN 'failed' ELSE 'skipped' END, CASE WHEN c_custkey % 10 = 1 THEN '302' ELSE '-' END, 1, '{M}/c/' || c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'redirect-loop' ELSE 'redirect-off-origin' END FROM customer WHERE c_custkey % 10 IN (1, 3)),
  o AS (SELECT *, row_number() OVER (ORDER BY depth, url) - 1 AS n, max(length(url)) OVER () AS width FROM p)
SELECT CAST(n AS BIGINT) AS created_ord, '  ' || rpad(state, 8, ' ') || '  ' || rpad(status, 6, ' ') || '  ' || rpad(CAST(depth AS VARCHAR), 5, ' ') || '  ' || rpad(url, CAST(width AS INT), ' ') || '  ' || reason AS line FROM o""")
def q_details_rows(spark, sf_dir):
    """The lines of the table of pages."""
    return report.details_rows(_crawled(spark, sf_dir, 1, 3).pages).select("created_ord", "line")


@query(f"""WITH p AS (SELECT '{M}/' AS url, 0 AS depth, 0 AS kind, 0 AS k UNION ALL SELECT '{M}/c/' || c_custkey, 1, 1, c_custkey FROM customer WHERE c_custkey % 10 = 1)
SELECT CAST(row_number() OVER (ORDER BY depth, url) - 1 AS BIGINT) AS created_ord, url || ',' || url || ',' || url || ',' || CASE depth WHEN 0 THEN '' ELSE '{M}/' END || ',' || depth || ',' ||
  CASE depth WHEN 0 THEN 'ok,,200,200,text/html,0,' || length(url) || ',1,,' ELSE 'failed,,200,302,,0,,1,redirect-loop,redirect loop' END AS line FROM p""")
def q_report_csv(spark, sf_dir):
    """The CSV report's lines: all fields of a page in their order."""
    return report.csv_lines(_crawled(spark, sf_dir, 1).pages)


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 2)
SELECT line, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT '[trace] redirect from={M}/c/' || k || ' to={M}/h/' || k || '/1 status=302' AS line FROM c UNION ALL
  SELECT '[trace] redirect from={M}/h/' || k || '/' || i || ' to={M}/h/' || k || '/' || (i + 1) || ' status=302' FROM c, range(1, 5) r(i) UNION ALL
  SELECT '[trace] attempt-start url={M}/c/' || k || ' attempt=1' FROM c UNION ALL SELECT '[trace] attempt-start url={M}/h/' || k || '/' || i || ' attempt=1' FROM c, range(1, 6) r(i) UNION ALL
  SELECT '[trace] attempt-start url={M}/ attempt=1' UNION ALL SELECT '[trace] attempt-start url={M}/robots.txt attempt=1') GROUP BY line""")
def q_trace_of_redirects(spark, sf_dir):
    """Lines of the trace: each redirect and attempt of chains of five."""
    lines = trace.lines(_crawled(spark, sf_dir, 2)).where(F.col("line").rlike(r"^\[trace\] (redirect|attempt-start) "))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT count(*) FILTER (c_custkey % 10 = 1) AS bad, count(*) FILTER (c_custkey % 10 = 3) AS away FROM customer),
  b AS (SELECT 3 AS block, unnest(['reserved', 'fetched', 'ok', 'skipped', 'failed', 'queued']) AS name, unnest([1 + bad + away, 1 + bad + away, 1, away, bad, 0]) AS n, unnest(range(6)) AS i FROM c),
  w AS (SELECT block, i, '  ' || rpad(name, CAST(max(length(name)) OVER () AS INT), ' ') || '  ' || lpad(CAST(n AS VARCHAR), CAST(max(length(CAST(n AS VARCHAR))) OVER () AS INT), ' ') AS line FROM b),
  l AS (SELECT 0 AS block, 0 AS i, 'completed {M}/ 0ms' AS line UNION ALL SELECT 1, 0, '' UNION ALL SELECT 2, 0, 'crawl' UNION ALL SELECT * FROM w UNION ALL SELECT 4, 0, '' UNION ALL SELECT 5, 0, 'skipped'
    UNION ALL SELECT 6, 0, '  redirect-off-origin  ' || away FROM c UNION ALL SELECT 7, 0, '' UNION ALL SELECT 8, 0, 'failed' UNION ALL SELECT 9, 0, '  redirect-loop  ' || bad FROM c
    UNION ALL SELECT 10, 0, '' UNION ALL SELECT 11, 0, 'robots' UNION ALL SELECT 12, 0, '  {M}  allow-all 404')
SELECT CAST(row_number() OVER (ORDER BY block, i) - 1 AS INT) AS n, line FROM l""")
def q_report_console(spark, sf_dir):
    """The console report, line by line; the clock stands still."""
    lines = report.console(_crawled(spark, sf_dir, 1, 3, clock=lambda: 0.0)).rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def _robots(spark, *answers: tuple):
    """Scripted responses: path, attempt, status, location, body."""
    return spark.createDataFrame([(M + path, attempt, status, "text/plain", to, None, None, body, None) for path, attempt, status, to, body in answers], site.RESPONSES)


_RULES = "User-agent: *\nDisallow: /\n\nUser-agent: skeinbot\nDisallow: /c/2\nAllow: /c/21$\nCrawl-delay: 1\n"


@query(f"""SELECT url, CASE WHEN denied THEN 'skipped' WHEN kind = 1 THEN 'failed' ELSE 'ok' END AS state, CASE WHEN denied THEN 'robots' WHEN kind = 1 THEN 'redirect-loop' END AS reason,
  CAST(CASE WHEN denied THEN 0 WHEN kind = 0 THEN 2 ELSE 1 END AS INT) AS attempts, CASE WHEN NOT denied THEN CAST(1000 AS BIGINT) END AS waited, CASE WHEN NOT denied THEN CAST(CASE WHEN kind = 0 THEN 1000 ELSE 0 END AS BIGINT) END AS duration FROM (
  SELECT '{M}/' AS url, 9 AS kind, false AS denied UNION ALL SELECT '{M}/c/' || c_custkey, c_custkey % 10, CAST(c_custkey AS VARCHAR) LIKE '2%' AND c_custkey <> 21 FROM customer WHERE c_custkey % 10 IN (0, 1))""")
def q_robots_crawled(spark, sf_dir):
    """A crawl under its product's own rules, read after a retry and a redirect; the crawl delay is the gap."""
    robots = _robots(spark, ("/robots.txt", 1, 503, None, None), ("/robots.txt", 2, 302, "/rules.txt", None), ("/rules.txt", 1, 200, None, _RULES))
    pages = _crawled(spark, sf_dir, 0, 1, robots=robots).pages
    return pages.select(F.col("canonicalUrl").alias("url"), "state", F.coalesce("skipReason", "errorKind").alias("reason"), "attempts", F.col("waitedMs").alias("waited"), F.col("durationMs").alias("duration"))


@query(f"""SELECT unnest(['500', '404', 'loop']) AS robots, unnest(['unavailable', 'allow-all', 'unavailable']) AS outcome, unnest(['http-status', NULL, 'redirect-loop']) AS kind, unnest(['skipped', 'ok', 'skipped']) AS state, unnest(['robots-unavailable', NULL, 'robots-unavailable']) AS reason""")
def q_robots_outcomes_crawled(spark, sf_dir):
    """What becomes of the start where robots.txt fails, isn't there, or leads to itself."""
    out = []
    for name, status, to in (("500", 500, None), ("404", 404, None), ("loop", 301, "/robots.txt")):
        result = _crawled(spark, sf_dir, robots=_robots(spark, ("/robots.txt", 1, status, to, None)), max_depth=0)
        start, summary = result.pages.select("state", "skipReason").first(), result.robots[0]
        out.append((name, summary["outcome"], summary["errorKind"], *start))
    return spark.createDataFrame(out, "robots string, outcome string, kind string, state string, reason string")
