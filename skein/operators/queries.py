"""Registered queries over the supplied tables, with their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import html, http, url
from skein.operators import politeness, robots
from skein.plans import crawl as engine
from skein.plans import trace
from skein.plans.config import CrawlConfig
from skein.shipping import ship
from skein.sources import site
from skein.sources.staging import held, ranked, scratch
from skein.streaming import crawl_streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query. The executors get this package before it runs; of what it stages, its result alone stays."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            with scratch() as keep:
                out = f(spark, sf_dir)
                return keep(out, f.__name__) if held() else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces that the SQL strings share. URLs of the pages table are of the common shape.
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1))"
_PORT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*:([0-9]*)', 1)"
_PATH = "CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_ORIGIN = f"{_SCHEME} || '://' || {_HOST} || CASE WHEN {_PORT} = '' OR ({_SCHEME} = 'http' AND {_PORT} = '80') OR ({_SCHEME} = 'https' AND {_PORT} = '443') THEN '' ELSE ':' || {_PORT} END"
_ENC = "replace(replace(replace(url_encode({}), '%20', '+'), '%2A', '*'), '~', '%7E')"
_PAIRS = f"""list_sort(list_transform(list_filter(string_split({_QUERY}, '&'), lambda p: p <> ''), lambda p: {{
  'name': url_decode(replace(string_split(p, '=')[1], '+', ' ')),
  'value': CASE WHEN instr(p, '=') > 0 THEN url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' ')) ELSE '' END}}))"""
_QS = f"array_to_string(list_transform({_PAIRS}, lambda q: {_ENC.format('q.name')} || '=' || {_ENC.format('q.value')}), '&')"
#: Characters beyond ASCII stand percent-encoded in a key, as the URL standard says.
_BARE = f"array_to_string(list_transform(string_split(regexp_replace({_PATH}, '/+$', ''), ''), lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '')"
_KEY = f"{_ORIGIN} || CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END || CASE WHEN {_QS} = '' THEN '' ELSE '?' || {_QS} END"
#: Root-relative links, as the pages table has them; characters beyond ASCII stand percent-encoded, as the URL standard says.
_LINKS = r"""SELECT page_id, page_url, pos, array_to_string(list_transform(string_split(regexp_replace(url, '#.*$', ''), ''), lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '') AS url FROM (
  SELECT page_id, page_url, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS url FROM (
  SELECT page_id, url AS page_url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM (
    SELECT page_id, url, list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1), lambda h: trim(h) <> '') AS hrefs FROM pages)))"""


def spellings(pages: DataFrame) -> DataFrame:
    """The pages' URLs and other spellings of them."""
    u = F.col("url")
    return pages.select("page_id", F.explode(F.array(u, F.concat(u, F.lit("#top")), F.concat(u, F.lit("?b=2&a=1+x&&c")), F.upper(u), F.regexp_replace(u, "^https?://([^/?#]*)", "HTTPS://$1:443"))).alias("url"))


_SPELLINGS = r"""SELECT page_id, unnest([url, url || '#top', url || '?b=2&a=1+x&&c', upper(url), regexp_replace(url, '^https?://([^/?#]*)', 'HTTPS://\1:443')]) AS url FROM pages"""


@query(f"SELECT page_id, url, {_KEY} AS key FROM ({_SPELLINGS})")
def q_canonical_key(spark, sf_dir):
    return url.with_key(spellings(_t(spark, sf_dir, "pages")), "url", "key")


@query(f"SELECT page_id, {_ORIGIN} AS origin, {_PATH} AS path, regexp_replace(url, '#.*$', '') AS spelling FROM ({_SPELLINGS})")
def q_origin_parts(spark, sf_dir):
    u = F.col("url")
    return spellings(_t(spark, sf_dir, "pages")).select("page_id", url.origin(u).alias("origin"), url.path(u).alias("path"), url.requested_spelling(u).alias("spelling"))


@query(f"SELECT page_id, url, {_QS} AS query FROM ({_SPELLINGS})")
def q_query_params(spark, sf_dir):
    return spellings(_t(spark, sf_dir, "pages")).select("page_id", "url", url.query_string(F.col("url")).alias("query"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, page_url, pos, url of every anchor, resolved; pages of plain markup and plain references stay in the JVM."""
    rows = html.with_links(pages.withColumn("page_url", F.col("url")), "html", "url", ["page_id", "page_url"])
    return url.with_resolved(rows, "raw", "base", "url").select("page_id", "page_url", "pos", "url")


@query(f"SELECT page_id, CAST(pos AS INT) AS pos, url FROM ({_LINKS})")
def q_links(spark, sf_dir):
    return links(_t(spark, sf_dir, "pages")).select("page_id", "pos", "url")


@query(f"SELECT page_id, CAST(pos AS INT) AS pos, url FROM ({_LINKS}) WHERE regexp_matches(url, '^https?://')")
def q_links_exact(spark, sf_dir):
    """The same links by the HTML tokenizer and the exact resolver alone."""
    return html.with_page(_t(spark, sf_dir, "pages"), "html", "url", "p").select("page_id", F.posexplode("p.links").alias("pos", "url"))


@query(f"SELECT page_id, key, arg_min(url, pos) AS spelling, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, pos, url, {_KEY} AS key FROM ({_LINKS})) GROUP BY page_id, key")
def q_links_first_spelling(spark, sf_dir):
    rows = url.with_key(links(_t(spark, sf_dir, "pages")), "url", "key")
    return rows.groupBy("page_id", "key").agg(F.min_by("url", "pos").alias("spelling"), F.count("*").alias("n"))


_ODD = r"""SELECT page_id, unnest([url, 'mailto:a@b.c', 'http://user:pw@' || substr(url, instr(url, '//') + 2), 'ftp://' || page_id, 'no-scheme']) AS url FROM pages"""


@query(rf"""SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'unparsable'
  WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'scheme' WHEN regexp_matches(url, '^[^/]*//[^/?#]*@') THEN 'userinfo' END AS reason FROM ({_ODD})) WHERE reason IS NOT NULL GROUP BY reason""")
def q_ignored_links(spark, sf_dir):
    u = F.col("url")
    after = F.substr(u, F.instr(u, "//") + F.lit(2), F.length(u))
    odd = F.array(u, F.lit("mailto:a@b.c"), F.concat(F.lit("http://user:pw@"), after), F.concat(F.lit("ftp://"), F.col("page_id")), F.lit("no-scheme"))
    rows = _t(spark, sf_dir, "pages").select(F.explode(odd).alias("url")).select(url.link_problem(F.col("url")).alias("reason"))
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


_SEGS = f"list_filter(string_split({_PATH}, '/')[2:], lambda s: true)"
_TRAPS = r"SELECT page_id, unnest([url, url || '/a/b/a/c/a', url || repeat('/x1', 2) || '//y', url || '/' || repeat('q', 80)]) AS url FROM pages"
_NAMED = f"list_filter({_SEGS}, lambda s: s <> '')"
_DEPTH = f"CASE WHEN {_PATH} = '/' THEN 0 ELSE len({_SEGS}) END"
_TRAP = f"CASE WHEN length(url) > 90 THEN 'url-length' WHEN {_DEPTH} > 6 THEN 'path-depth' WHEN coalesce(list_max(list_transform({_NAMED}, lambda s: len(list_filter({_NAMED}, lambda x: x = s)))), 0) > 2 THEN 'repeated-segment' END"


@query(f"SELECT page_id, url, {_TRAP} AS reason FROM ({_TRAPS})")
def q_trap_reason(spark, sf_dir):
    u = F.col("url")
    more = F.array(u, F.concat(u, F.lit("/a/b/a/c/a")), F.concat(u, F.lit("/x1/x1//y")), F.concat(u, F.lit("/"), F.repeat(F.lit("q"), 80)))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.explode(more).alias("url"))
    return rows.select("page_id", "url", url.trap_reason(u, 90, 6, 2).alias("reason"))


@query(f"SELECT page_id, CAST({_DEPTH} AS INT) AS segments FROM pages")
def q_path_depth(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.size(url.path_segments(F.col("url"))).alias("segments"))


#: Scope is the origin with most pages (ties: the first by name); a trap is a path of more than one segment, or a key of more than 44 characters.
_KEY_PARTS = _TRAP.replace("length(url) > 90", "length(url) > 44").replace("> 6 THEN", "> 1 THEN")
_DECIDED = f"""SELECT key, first_page, CASE WHEN origin <> (SELECT arg_min(o, (-n, o)) FROM (SELECT {_ORIGIN} AS o, count(*) AS n FROM pages GROUP BY 1)) THEN 'other-origin' ELSE trap END AS reason FROM (
  SELECT url AS key, first_page, {_ORIGIN} AS origin, {_KEY_PARTS} AS trap FROM (SELECT key AS url, min(page_id) AS first_page FROM (SELECT page_id, {_KEY} AS key FROM ({_LINKS})) GROUP BY key))"""


def _decided(spark, sf_dir) -> DataFrame:
    """Candidates of all pages, each at the first page that links to it: another origin than the one with most pages, or a trap."""
    pages = _t(spark, sf_dir, "pages")
    scope = pages.groupBy(url.origin(F.col("url")).alias("o")).agg((-F.count("*")).alias("n")).agg(F.min_by("o", F.struct("n", "o"))).first()[0]
    rows = url.with_key(links(pages), "url", "key").groupBy("key").agg(F.min("page_id").alias("first_page"))
    trap = url.trap_reason(F.col("key"), 44, 1, 2)
    return rows.select("key", "first_page", F.when(url.origin(F.col("key")) != F.lit(scope), "other-origin").otherwise(trap).alias("reason"))


@query(f"SELECT coalesce(reason, 'queued') AS decision, CAST(count(*) AS BIGINT) AS n FROM ({_DECIDED}) GROUP BY 1")
def q_admission_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("queued")).alias("decision")).agg(F.count("*").alias("n"))


@query(f"""SELECT key, CASE WHEN reason IS NULL AND before >= 200 THEN 'page-limit' ELSE coalesce(reason, 'queued') END AS decision FROM (
  SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY first_page, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_DECIDED}))""")
def q_page_limit_cut(spark, sf_dir):
    rows = ranked(_decided(spark, sf_dir), ["first_page", "key"], "n", F.col("reason").isNull().cast("int"))
    full = F.col("reason").isNull() & (F.col("before") >= 200)
    return rows.select("key", F.when(full, "page-limit").otherwise(F.coalesce("reason", F.lit("queued"))).alias("decision"))


# ---------------------------------------------------------------- crawls of the relational site

_SITE = """WITH s(url, parent, depth, status) AS (
  SELECT 'https://site.test/', NULL, 0, 'F' UNION ALL SELECT 'https://site.test/r/' || r_regionkey, 'https://site.test/', 1, 'F' FROM region
  UNION ALL SELECT 'https://site.test/n/' || n_nationkey, 'https://site.test/r/' || n_regionkey, 2, 'F' FROM nation
  UNION ALL SELECT 'https://site.test/c/' || c_custkey, 'https://site.test/n/' || c_nationkey, 3, 'F' FROM customer
  UNION ALL SELECT 'https://site.test/o/' || o_orderkey, 'https://site.test/c/' || o_custkey, 4, o_orderstatus FROM orders)
"""
_STATE = "CASE status WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped' ELSE 'failed' END"


def _crawled(spark, sf_dir, depth: int, most: int = 10**9) -> engine.CrawlResult:
    config = CrawlConfig(start_url=f"{site.SITE}/", max_depth=depth, max_pages=most)
    return engine.crawl(spark, config, site.relational_site(spark, sf_dir))


@query(_SITE + f"""SELECT url, parent, depth, {_STATE} AS state, CASE status WHEN 'O' THEN 'non-html' END AS skip_reason, CASE status WHEN 'P' THEN 'http-status' END AS error_kind FROM s""")
def q_bfs_pages(spark, sf_dir):
    pages = _crawled(spark, sf_dir, 4).pages
    return pages.select(F.col("canonicalUrl").alias("url"), F.col("discoveredFrom").alias("parent"), "depth", "state", F.col("skipReason").alias("skip_reason"), F.col("errorKind").alias("error_kind"))


@query(_SITE + "SELECT url, depth, CASE WHEN depth > 2 THEN 'depth-limit' ELSE 'ok' END AS verdict FROM s WHERE depth <= 3")
def q_bfs_depth_limit(spark, sf_dir):
    return _crawled(spark, sf_dir, 2).pages.select(F.col("canonicalUrl").alias("url"), "depth", F.coalesce("skipReason", "state").alias("verdict"))


@query(_SITE + """, o AS (SELECT url, depth, parent, row_number() OVER (ORDER BY depth, p, url) AS n FROM (
    SELECT s.*, (SELECT row_number FROM (SELECT url AS u, row_number() OVER (ORDER BY depth, parent2, url) AS row_number FROM (
      SELECT s2.url, s2.depth, coalesce(s2.parent, '') AS parent2 FROM s s2 WHERE s2.depth <= 1)) WHERE u = s.parent) AS p FROM s WHERE depth <= 2))
SELECT url, CASE WHEN n > 20 THEN 'page-limit' ELSE 'ok' END AS verdict FROM o""")
def q_bfs_page_limit(spark, sf_dir):
    pages = _crawled(spark, sf_dir, 2, 20).pages.where("depth <= 2")
    return pages.select(F.col("canonicalUrl").alias("url"), F.coalesce("skipReason", "state").alias("verdict"))


@query(_SITE + """SELECT CAST(count(*) AS BIGINT) AS reserved, CAST(0 AS BIGINT) AS queued, CAST(count(*) AS BIGINT) AS fetched, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS ok,
  CAST(count(*) FILTER (status = 'O') AS BIGINT) AS skipped, CAST(count(*) FILTER (status = 'P') AS BIGINT) AS failed FROM s""")
def q_bfs_counts(spark, sf_dir):
    return _crawled(spark, sf_dir, 4).counts()


@query(_SITE + "SELECT 'skipped' AS state, 'non-html' AS name, CAST(count(*) AS BIGINT) AS n FROM s WHERE status = 'O' UNION ALL SELECT 'failed', 'http-status', CAST(count(*) AS BIGINT) FROM s WHERE status = 'P'")
def q_tallies(spark, sf_dir):
    pages = _crawled(spark, sf_dir, 4).pages
    parts = [engine.tally(pages, s, c).select(F.lit(s).alias("state"), "name", F.col("count").alias("n")) for s, c in (("skipped", "skipReason"), ("failed", "errorKind"))]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- HTTP rules over orders and events

_STATUS = "[200, 301, 404, 429, 500, 502, 503, 504][o_orderkey % 8 + 1]"
_TYPE = "['text/html; charset=utf-8', ' Application/XHTML+XML ;q=1', 'text/plain', NULL, 'TEXT/HTML', 'text/htmlx'][o_orderkey % 6 + 1]"
_CODE = "['TimeoutError', 'ENOTFOUND', 'EAI_AGAIN', 'ECONNREFUSED', 'UND_ERR_CONNECT_TIMEOUT', 'ECONNRESET', 'UND_ERR_SOCKET', 'EPIPE', 'DEPTH_ZERO_SELF_SIGNED_CERT', 'CERT_HAS_EXPIRED', 'ERR_TLS_X', 'OTHER'][o_orderkey % 12 + 1]"


def _pick(values: list, key: str = "o_orderkey"):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


_STATUSES = [200, 301, 404, 429, 500, 502, 503, 504]
#: Error codes of the network, as they must be recognised.
_CODES = "TimeoutError ENOTFOUND EAI_AGAIN ECONNREFUSED UND_ERR_CONNECT_TIMEOUT ECONNRESET UND_ERR_SOCKET EPIPE DEPTH_ZERO_SELF_SIGNED_CERT CERT_HAS_EXPIRED ERR_TLS_X OTHER".split()


@query(f"SELECT o_orderkey, coalesce(lower(trim(string_split({_TYPE}, ';')[1])) IN ('text/html', 'application/xhtml+xml'), false) AS is_html FROM orders")
def q_is_html(spark, sf_dir):
    kind = _pick(["text/html; charset=utf-8", " Application/XHTML+XML ;q=1", "text/plain", None, "TEXT/HTML", "text/htmlx"])
    return _t(spark, sf_dir, "orders").select("o_orderkey", http.is_html(kind).alias("is_html"))


@query(f"""SELECT o_orderkey, CASE WHEN c = 'TimeoutError' THEN 'timeout' WHEN c IN ('ENOTFOUND', 'EAI_AGAIN') THEN 'dns' WHEN c IN ('ECONNREFUSED', 'UND_ERR_CONNECT_TIMEOUT') THEN 'connect'
  WHEN c IN ('ECONNRESET', 'UND_ERR_SOCKET', 'EPIPE') THEN 'reset' WHEN c = 'DEPTH_ZERO_SELF_SIGNED_CERT' OR c LIKE 'CERT\\_%' ESCAPE '\\' OR c LIKE 'ERR\\_TLS\\_%' ESCAPE '\\' THEN 'tls' ELSE 'connect' END AS kind,
  'fetch failed (' || c || ')' AS message FROM (SELECT o_orderkey, {_CODE} AS c FROM orders)""")
def q_error_kind(spark, sf_dir):
    code = _pick(_CODES)
    return _t(spark, sf_dir, "orders").select("o_orderkey", http.error_kind(code).alias("kind"), http.error_message(F.lit("fetch failed"), code).alias("message"))


@query(f"SELECT o_orderkey, {_STATUS} IN (429, 500, 502, 503, 504) AS retry, CAST(least(5000, 500 * pow(2, o_orderkey % 6)) AS BIGINT) AS backoff FROM orders")
def q_retryable(spark, sf_dir):
    tries = F.col("o_orderkey") % 6 + 1
    return _t(spark, sf_dir, "orders").select("o_orderkey", http.retryable(_pick(_STATUSES), F.lit(None).cast("string")).alias("retry"), http.backoff_ms(tries, F.lit(500)).alias("backoff"))


@query(f"""SELECT o_orderkey, CASE WHEN w <= 5000 THEN w END AS wait FROM (SELECT o_orderkey, CASE WHEN s IN (429, 503) AND h IS NOT NULL THEN greatest(b, CAST(h AS BIGINT) * 1000) ELSE b END AS w FROM (
  SELECT o_orderkey, {_STATUS} AS s, [NULL, '1', '4', '9'][o_orderkey // 8 % 4 + 1] AS h, CAST(least(5000, 500 * pow(2, o_orderkey % 3)) AS BIGINT) AS b FROM orders))""")
def q_retry_wait(spark, sf_dir):
    after = F.element_at(F.array(F.lit(None).cast("string"), F.lit("1"), F.lit("4"), F.lit("9")), (F.floor(F.col("o_orderkey") / 8) % 4 + 1).cast("int"))
    wait = http.retry_wait_ms(_pick(_STATUSES), after, F.col("o_orderkey") % 3 + 1, F.lit(500), F.lit(0))
    return _t(spark, sf_dir, "orders").select("o_orderkey", wait.alias("wait"))


# ---------------------------------------------------------------- identity of content

@query("SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner FROM documents")
def q_content_dedupe(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", http.content_hash(F.col("text")).alias("sha"))
    owners = rows.groupBy("sha").agg(F.min("doc_id").alias("owner"))
    return rows.join(owners, "sha").select("doc_id", "sha", (F.col("doc_id") > F.col("owner")).alias("duplicate"), "owner")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT sha256(text)) AS BIGINT) AS repeats FROM documents GROUP BY source")
def q_dup_by_source(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").groupBy("source", http.content_hash(F.col("text")).alias("sha")).agg(F.count("*").alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("n"), (F.sum("n") - F.count("*")).alias("repeats"))


# ---------------------------------------------------------------- robots, pacing, budgets

RULES = [(False, "/private"), (True, "/private/open"), (False, "/*.pdf$"), (False, "/a"), (True, "/a")]


@query(rf"""SELECT page_id, path, coalesce((SELECT arg_max(allow, len * 2 + CAST(allow AS INT)) FROM (VALUES (false, 8, '^/private'), (true, 13, '^/private/open'), (false, 7, '^/.*\.pdf$'), (false, 2, '^/a'), (true, 2, '^/a')) r(allow, len, re)
  WHERE regexp_matches(path, re)), true) AS allowed FROM (SELECT page_id, unnest(['/private/' || page_id, '/private/open/' || page_id, '/x' || page_id || '.pdf', '/a' || page_id, '/b']) AS path FROM pages)""")
def q_robots_decision(spark, sf_dir):
    p = F.col("page_id").cast("string")
    paths = F.array(F.concat(F.lit("/private/"), p), F.concat(F.lit("/private/open/"), p), F.concat(F.lit("/x"), p, F.lit(".pdf")), F.concat(F.lit("/a"), p), F.lit("/b"))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.explode(paths).alias("path"))
    return rows.select("page_id", "path", robots.allowed(F.concat(F.lit("https://e.test"), F.col("path")), RULES).alias("allowed"))


@query(f"SELECT o_orderkey, CASE WHEN s BETWEEN 200 AND 299 THEN 'parsed' WHEN s BETWEEN 400 AND 499 AND s <> 429 THEN 'allow-all' ELSE 'unavailable' END AS outcome, CASE WHEN s BETWEEN 200 AND 299 AND d > 0 THEN least(10000, greatest(200, d * 1000)) ELSE 200 END AS gap FROM (SELECT o_orderkey, {_STATUS} AS s, CAST(o_orderkey % 13 AS BIGINT) AS d FROM orders)")
def q_robots_outcome(spark, sf_dir):
    out = robots.outcome(_pick(_STATUSES), F.lit(None).cast("string"))
    gap = robots.gap_ms(out, (F.col("o_orderkey") % 13).cast("double"), F.lit(200))
    return _t(spark, sf_dir, "orders").select("o_orderkey", out.alias("outcome"), gap.alias("gap"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ready, 60000 + 1000 * (event_id % 7) AS gap FROM events),
g AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE greatest(gap, lag(gap) OVER w) END AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ready, event_id)),
c AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ready, event_id) AS c FROM g)
SELECT event_id, CAST(c + max(ready - c) OVER (PARTITION BY user_id ORDER BY ready, event_id) AS BIGINT) AS start_ms FROM c""")
def q_politeness_start(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ready"))
    return politeness.start_times(rows, "user_id", "ready", (F.lit(60000) + 1000 * (F.col("event_id") % 7)).cast("bigint"), ["ready", "event_id"]).select("event_id", "start_ms")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS ready_ms, event_id % 5 * 1000 AS hold_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT user_id, id, ready_ms, hold_ms, n, ready_ms AS take_ms, ready_ms AS start_ms, CAST(-1 AS BIGINT) AS first_end, ready_ms + hold_ms AS last_end FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.id, e.ready_ms, e.hold_ms, e.n, greatest(e.ready_ms, s.first_end), greatest(e.ready_ms, s.first_end, s.start_ms + 200),
    least(s.last_end, greatest(e.ready_ms, s.first_end, s.start_ms + 200) + e.hold_ms), greatest(s.last_end, greatest(e.ready_ms, s.first_end, s.start_ms + 200) + e.hold_ms)
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, id, CAST(ready_ms AS BIGINT) AS ready_ms, CAST(hold_ms AS BIGINT) AS hold_ms, CAST(take_ms AS BIGINT) AS take_ms, CAST(start_ms AS BIGINT) AS start_ms FROM s""")
def q_lease_sim(spark, sf_dir):
    """Two leases a user: when a request gets one, and when it starts."""
    rows = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ready_ms"), (F.col("event_id") % 5 * 1000).alias("hold_ms"))
    return politeness.lease_times(rows, "user_id", 2, 200)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= 500 AS granted FROM events")
def q_budget_cut(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "ts")
    return politeness.budget_cut(rows, ["ts", "event_id"], 500).select("event_id", "granted")


# ---------------------------------------------------------------- lines

@query(f"""SELECT page_id, CASE WHEN length(url) <= 64 THEN url WHEN length(o) + 3 >= 64 THEN o || '...' ELSE o || substr(rest, 1, head) || '...' || substr(rest, length(rest) - (room - head) + 1) END AS shown FROM (
  SELECT *, CAST(ceil(room / 2.0) AS BIGINT) AS head, substr(url, length(o) + 1) AS rest FROM (SELECT page_id, url, o, 61 - length(o) AS room FROM (SELECT page_id, url, {_ORIGIN} AS o FROM (SELECT page_id, url || '/' || repeat('segment-', CAST(page_id % 9 AS INT)) AS url FROM pages))))""")
def q_display_url(spark, sf_dir):
    u = F.concat("url", F.lit("/"), F.repeat(F.lit("segment-"), (F.col("page_id") % 9).cast("int")))
    return _t(spark, sf_dir, "pages").select("page_id", u.alias("u")).select("page_id", url.display_url(F.col("u")).alias("shown"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang || ',' AS line FROM documents""")
def q_csv_lines(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", http.csv_line(F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("line"))


@query("""SELECT page_id, '[trace] take url=' || CASE WHEN regexp_matches(url, '^[A-Za-z0-9._:/-]+$') THEN url ELSE CAST(to_json(url) AS VARCHAR) END || ' depth=' || (page_id % 3) || ' sequence=' || page_id AS line FROM pages""")
def q_trace_lines(spark, sf_dir):
    """Lines of all pages; values with other characters are quoted, null fields left out."""
    line = http.trace_line("take", url=F.col("url"), depth=F.col("page_id") % 3, sequence=F.col("page_id"), reason=F.lit(None).cast("string"))
    return _t(spark, sf_dir, "pages").select("page_id", line.alias("line"))


@query(f"SELECT o_orderkey, '  https://o.test  ' || CASE WHEN s = 200 THEN 'parsed 200' ELSE 'unavailable ' || s || ' http-status' END AS line FROM (SELECT o_orderkey, {_STATUS} AS s FROM orders)")
def q_robots_lines(spark, sf_dir):
    s = _pick(_STATUSES)
    fine = s == 200
    return _t(spark, sf_dir, "orders").select("o_orderkey", http.robots_line(F.lit("https://o.test"), F.when(fine, "parsed").otherwise("unavailable"), s, F.when(~fine, "http-status")).alias("line"))


@query(_SITE + "SELECT parent, url, depth FROM s WHERE parent IS NOT NULL")
def q_edges_first_discovery(spark, sf_dir):
    return _crawled(spark, sf_dir, 4).edges.select(F.col("discoveredFrom").alias("parent"), F.col("canonicalUrl").alias("url"), "depth")


@query(_SITE + "SELECT parent, CAST(count(*) AS BIGINT) AS broken FROM s WHERE status = 'P' GROUP BY parent")
def q_broken_links(spark, sf_dir):
    pages = _crawled(spark, sf_dir, 4).pages.where("state = 'failed'")
    return pages.groupBy(F.col("discoveredFrom").alias("parent")).agg(F.count("*").alias("broken"))


@query(_SITE + """, c AS (SELECT count(*) AS pages, count(*) FILTER (depth <= 2) AS taken FROM s WHERE depth <= 3)
SELECT unnest(['crawl-start', 'reserved', 'skipped', 'take', 'robots-check', 'attempt-start', 'links', 'commit', 'crawl-stop']) AS event,
  CAST(unnest([1, taken, pages - taken, taken, taken, taken + 1, taken, taken, 1]) AS BIGINT) AS n FROM c""")
def q_trace_events(spark, sf_dir):
    """Events of a crawl of depth 2: every page was asked once, and robots.txt too."""
    return trace.events(_crawled(spark, sf_dir, 2)).groupBy("event").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT {_KEY} AS key FROM ({_LINKS})")
def q_first_seen(spark, sf_dir):
    return crawl_streams.first_seen(links(_t(spark, sf_dir, "pages"))).select("key")
