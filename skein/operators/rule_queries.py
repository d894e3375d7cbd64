"""Queries over single rules: URL identity on odd URLs, HTML heads, retries and their times, leases, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import html, http, url
from skein.operators.queries import _KEY, _LINKS, _pick, _t, query
from skein.plans import report
from skein.sources import site

#: Spellings of a page's URL, each with what is to be seen in its key: dot segments, escapes, case, ports, outer space, queries in another order, and very long ones.
def _spelled(u):
    own = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    origin, path = F.regexp_extract(u, "^([a-z]+://[^/?#]*)", 1), F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    upper = F.regexp_replace(u, "^[a-z]+://[^/?#]*", "")
    return F.array(own("  ", u, " "), own(F.upper(origin), upper), own(origin, "/a/b/../.", path, "/."), own(origin, path, "/%C3%A9\u00e9 <"), own(origin, path, "?b=%zz&a=1+2&&c&a=0&~=%7e"), own(origin, ":0443", path), own(origin, path, "?q=", F.repeat(F.lit("a=%41&"), 2000)),
                   own(origin, "\\x", path), F.regexp_replace(u, "://", "://u@"), F.regexp_replace(u, "^[a-z]+", "ftp"), path)


_SPELLED_SQL = """[o || coalesce(nullif(bare, ''), '/') || q, o || coalesce(nullif(bare, ''), '/') || q, o || '/a' || bare, o || rawpath || '/%C3%A9%C3%A9%20%3C', o || coalesce(nullif(bare, ''), '/') || '?a=0&a=1+2&b=%25zz&c=&%7E=%7E',
  o || CASE WHEN o LIKE 'http:%' THEN ':443' ELSE '' END || coalesce(nullif(bare, ''), '/'), o || coalesce(nullif(bare, ''), '/') || '?' || rtrim(repeat('a=A&', 1999), '&') || '&q=a%3DA', o || '/x' || bare, NULL, NULL, NULL]"""


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS rawpath, {_KEY} AS key FROM pages),
b AS (SELECT page_id, o, rawpath, rtrim(rawpath, '/') AS bare, regexp_extract(key, '(\\?.*)$', 1) AS q FROM p)
SELECT page_id, unnest(range(11)) AS n, unnest({_SPELLED_SQL}) AS key FROM b""")
def q_url_identity(spark, sf_dir):
    """The keys of all pages' URLs in odd spellings."""
    rows = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(_spelled(F.col("url"))).alias("n", "url"))
    return url.with_key(rows, "url", "key").select("page_id", F.col("n").cast("bigint").alias("n"), "key")


@query(rf"""SELECT h.page_id, o || '/d' || h.page_id || '/' AS base, 'c?x=' || h.page_id AS canonical, o || '/d' || h.page_id || '/p ' || o || '/q https://h.test/' || coalesce(own, '') AS links,
  'scheme mailto:x, userinfo http://u@h.test/, unparsable http://[' AS ignored FROM (SELECT page_id, 'https://e' || page_id || '.test' AS o FROM pages) h
  LEFT JOIN (SELECT page_id, string_agg(' https://e' || page_id || '.test' || regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '' ORDER BY pos) AS own FROM ({_LINKS}) GROUP BY page_id) l USING (page_id)""")
def q_html_head(spark, sf_dir):
    """Base, canonical and links of each page behind a head with a base: the first base and canonical count, templates, scripts and comments don't."""
    page = F.concat(
        F.lit('<!-- <base href="/no/"> --><template><base href="/no/"><a href="no">n</a></template><base href="/d'), F.col("page_id"), F.lit('/"><base href="/later/"><link rel="next" href="n"><link rel="x CANONICAL" href="c?x='), F.col("page_id"),
        F.lit("\"><link rel=canonical href=second><script>'<a href=no>'</script><a href=p>1</a><a name=x>2</a><a href=' '>3</a><a href='../q#f'>4</a><a href=\"//H.test\">5</a><a href=mailto:x>6</a><a href=http://u@h.test/>7</a><a href='http://['>8</a>"), F.coalesce("html", F.lit("")),
    )
    rows = _t(spark, sf_dir, "pages").select("page_id", page.alias("html"), F.concat(F.lit("https://e"), F.col("page_id"), F.lit(".test/x/y")).alias("u"))
    return html.with_page(rows, "html", "u", "p").select("page_id", "p.base", "p.canonical", F.array_join("p.links", " ").alias("links"), F.array_join(F.transform("p.ignored", lambda i: F.concat_ws(" ", i["reason"], i["raw"])), ", ").alias("ignored"))


_FORMS = ["%a, %d %b %Y %H:%M:%S GMT", "%A, %d-%b-%y %H:%M:%S GMT", "%a %b %-d %H:%M:%S %Y"]


@query("SELECT o_orderkey, form, CAST(greatest(0, epoch_ms(o_orderdate) - 788918400000) AS BIGINT) AS wait FROM (SELECT o_orderkey, date_trunc('second', o_orderdate) AS o_orderdate FROM orders), (VALUES (0), (1), (2)) f(form)")
def q_retry_dates(spark, sf_dir):
    """Retry-After as an HTTP date in its three forms, seen from the first moment of 1995."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    named = lambda form: F.date_format(F.to_utc_timestamp("t", F.current_timezone()), form)
    days = F.element_at(F.array(*map(F.lit, "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split())), F.dayofweek(F.to_utc_timestamp("t", F.current_timezone())))
    forms = [F.concat(named("EEE"), F.lit(", "), named("dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(days, F.lit(", "), named("dd-MMM-yy HH:mm:ss"), F.lit(" GMT")), F.concat(named("EEE MMM"), F.lit(" "), F.lpad(named("d"), 2, " "), F.lit(" "), named("HH:mm:ss yyyy"))]
    rows = rows.select("o_orderkey", F.posexplode(F.array(*forms)).alias("form", "header"))
    return rows.select("o_orderkey", "form", http.retry_after_ms(F.col("header"), F.lit(788918400000)).alias("wait"))


#: What the attempts at an order's URL answer, by its key modulo 6.
_SCRIPTS = {0: [200], 1: [503, 200], 2: [503, 503, 503], 3: [404], 4: [500, 429], 5: [None, 200]}
_SCRIPT_SQL = ", ".join(f"({k}, {i + 1}, {'NULL' if v is None else v}, {'true' if i + 1 == len(s) else 'false'})" for k, s in _SCRIPTS.items() for i, v in enumerate(s))


@query(f"""WITH RECURSIVE s(kind, attempt, status, final) AS (VALUES {_SCRIPT_SQL}),
f AS (SELECT kind, attempt, status FROM s UNION ALL SELECT s.kind, a.attempt, s.status FROM s, (VALUES (2), (3)) a(attempt) WHERE s.final AND a.attempt > s.attempt),
t AS (SELECT o_orderkey, f.attempt, status, 50 + o_orderkey % 7 AS took, CASE WHEN status IN (503, 429) AND o_orderkey % 5 = 0 THEN 1000 ELSE 0 END AS asked FROM orders JOIN f ON f.kind = o_orderkey % 6),
n AS (SELECT *, (status IS NULL OR status IN (429, 500, 503)) AND attempt < 3 AS again, greatest(500 * pow(2, attempt - 1), asked) AS wait FROM t),
m AS (SELECT *, coalesce(bool_and(again) OVER (PARTITION BY o_orderkey ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS made FROM n)
SELECT o_orderkey, CAST(attempt AS INT) AS attempt, CAST(status AS INT) AS status, CASE WHEN status IS NULL THEN 'reset' END AS kind, CASE WHEN again THEN CAST(wait AS BIGINT) END AS wait, CAST(took AS BIGINT) AS took,
  CAST(coalesce(sum(took + wait) OVER (PARTITION BY o_orderkey ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM m WHERE made""")
def q_attempt_timeline(spark, sf_dir):
    """Each attempt at scripted URLs: what came of it, when it starts after the first, and the wait after it."""
    scripts = spark.createDataFrame([(k, i + 1, v) for k, s in _SCRIPTS.items() for i, v in enumerate(s)], "kind int, attempt int, status_code int")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("int").alias("kind"))
    rows = orders.join(F.broadcast(scripts), "kind").select(
        F.col("o_orderkey").cast("string").alias("url"), "attempt", "status_code", F.lit("text/plain").alias("content_type"), F.lit(None).cast("string").alias("location"),
        F.when(F.col("status_code").isin(503, 429) & (F.col("o_orderkey") % 5 == 0), "1").alias("retry_after"), F.lit(None).cast("string").alias("content_length"), F.lit(None).cast("string").alias("body"),
        F.when(F.col("status_code").isNull(), "ECONNRESET").alias("error_code"), (50 + F.col("o_orderkey") % 7).alias("duration_ms"),
    )
    settled = site.settle(rows, 2, 500, 1_000_000).select(F.col("url").cast("bigint").alias("o_orderkey"), "tries")
    start = lambda k: F.aggregate(F.slice("tries", 1, k), F.lit(0).cast("bigint"), lambda s, t: s + t["duration"] + F.coalesce(t["wait"], F.lit(0)))
    each = settled.select("o_orderkey", F.posexplode(F.transform("tries", lambda t, k: F.struct(t["status"].alias("status"), t["kind"].alias("kind"), t["wait"].alias("wait"), t["duration"].alias("took"), start(k).alias("start_ms")))).alias("n", "t"))
    return each.select("o_orderkey", (F.col("n") + 1).alias("attempt"), "t.*")


@query("""SELECT o_orderkey, CASE WHEN st IN ('ok', 'failed') AND code IS NOT NULL THEN CAST(code AS VARCHAR) ELSE '-' END AS status, CASE st WHEN 'skipped' THEN 'robots' WHEN 'failed' THEN 'dns' ELSE '-' END AS reason
  FROM (SELECT o_orderkey, ['ok', 'skipped', 'failed', 'queued'][o_orderkey % 4 + 1] AS st, CASE WHEN o_orderkey % 3 > 0 THEN 200 + o_orderkey % 300 END AS code FROM orders)""")
def q_detail_cells(spark, sf_dir):
    state = _pick(["ok", "skipped", "failed", "queued"])
    code = F.when(F.col("o_orderkey") % 3 > 0, 200 + F.col("o_orderkey") % 300)
    return _t(spark, sf_dir, "orders").select("o_orderkey", http.status_cell(state, code).alias("status"), http.reason_cell(state, F.lit("robots"), F.lit("dns")).alias("reason"))


@query("""SELECT doc_id, coalesce(try_cast(declared AS DOUBLE) > 500, false) OR coalesce(octet_length(encode(text)) > 500, false) AS too_large FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '501' WHEN 1 THEN '500' WHEN 2 THEN 'many' END AS declared FROM documents)""")
def q_too_large(spark, sf_dir):
    """Bodies over the limit, by what is declared or by their bytes."""
    declared = F.when(F.col("doc_id") % 4 == 0, "501").when(F.col("doc_id") % 4 == 1, "500").when(F.col("doc_id") % 4 == 2, "many")
    return _t(spark, sf_dir, "documents").select("doc_id", http.too_large(declared, F.col("text"), 500).alias("too_large"))


@query("""SELECT s_suppkey, 'Bot' || s_suppkey AS token, 'https://***@h' || s_suppkey || '.test/' AS redacted, 'https://h.test/@' || s_suppkey AS plain FROM supplier""")
def q_tokens_and_redaction(spark, sf_dir):
    """The product token of a user agent; a URL with user name shows no more than its host."""
    n = F.col("s_suppkey").cast("string")
    agent = F.concat(F.lit("Bot"), n, F.element_at(F.array(F.lit("/1.0 (x)"), F.lit(" y/2"), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int")))
    secret, plain = F.concat(F.lit("https://u:p@h"), n, F.lit(".test/a?b")), F.concat(F.lit("https://h.test/@"), n)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", url.product_token(agent).alias("token"), url.redact_userinfo(secret).alias("redacted"), url.redact_userinfo(plain).alias("plain"))


#: Forms of references made of a real root-relative href (/x): as it is, relative, up one and two folders, of a host, a query, with dots inside, and with what is to be escaped.
def _forms(href):
    rest = F.substr(href, F.lit(2), F.length(href))
    own = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.array(href, rest, own("./", rest, "#top"), own("../", rest), own("../../", rest, "/."), own("//H.test:80", href), own("?q=", rest), own("/a/./b/../..", href, "/%2e%2E/"), own(" ", href, " <{\"}>?'x' "), own("#", rest))


_FORMS_SQL = """[o || e, d || substr(e, 2), d || substr(e, 2), u || substr(e, 2), uu || substr(e, 2) || '/', s || '://h.test' || CASE WHEN s = 'https' THEN ':80' ELSE '' END || e,
  o || p || '?q=' || substr(e, 2), o || CASE WHEN contains(substr(e, 2), '/') THEN regexp_replace(e, '[^/]*$', '') ELSE '/' END, o || e || '%20%3C%7B%22%7D%3E?%27x%27', o || p || q]"""


@query(rf"""WITH l AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM (
  SELECT page_id, url, list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1), lambda h: trim(h) <> '') AS hrefs FROM pages)),
m AS (SELECT page_id, pos, array_to_string(list_transform(string_split(href, ''), lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '') AS e, lower(regexp_extract(url, '^([a-z]+):', 1)) AS s,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) END AS p,
  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM l),
n AS (SELECT *, o || regexp_replace(p, '[^/]*$', '') AS d, o || regexp_replace(regexp_replace(p, '[^/]*$', ''), '[^/]+/$', '') AS u FROM m),
k AS (SELECT *, o || regexp_replace(substr(u, length(o) + 1), '[^/]+/$', '') AS uu FROM n)
SELECT page_id, CAST(pos AS INT) AS pos, unnest(range(10)) AS form, unnest({_FORMS_SQL}) AS resolved FROM k""")
def q_resolved(spark, sf_dir):
    """References of every form, made of the pages' real hrefs, against their pages' URLs."""
    rows = html.with_links(_t(spark, sf_dir, "pages"), "html", "url", ["page_id"])
    rows = rows.select("page_id", "pos", "base", F.posexplode(_forms(F.col("raw"))).alias("form", "raw"))
    return url.with_resolved(rows, "raw", "base", "resolved").select("page_id", "pos", F.col("form").cast("bigint").alias("form"), "resolved")


@query(r"""SELECT page_id, '[debug] ignored ' || unnest(['scheme mailto:x', 'userinfo https://u@h.test/', 'unparsable http://[ x']) || ' base ' || url AS line FROM pages""")
def q_ignored_lines(spark, sf_dir):
    """Debug lines of links that are no candidates, in the page's order."""
    page = F.concat("html", F.lit("""<a href='mailto:x'>1</a><a href="https://u@h.test/">2</a><a href="http://[\n\nx">3</a>"""))
    return report.ignored_lines(_t(spark, sf_dir, "pages").select("page_id", "url", page.alias("html"))).select("page_id", "line")
