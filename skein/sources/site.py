"""Stored webs for the crawl: scripted responses, and a site made from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import html, http, url
from skein.sources.stored import StoredWeb

RESPONSES = "url string, attempt int, status_code int, content_type string, location string, retry_after string, content_length string, body string, error_code string"
SITE = "https://site.test"


def settle(responses: DataFrame, retry_count: int, base_ms: int, max_bytes: int) -> DataFrame:
    """One row a URL from its scripted attempts, by the retry rules; the last script repeats.

    tries has each attempt that is made: its status or kind, the wait after it, and its duration_ms if the scripts say so.
    """
    took = (F.col("duration_ms") if "duration_ms" in responses.columns else F.lit(0)).cast("bigint")
    kind = F.when(F.col("error_code").isNotNull(), http.error_kind(F.col("error_code")))
    ok_html = F.col("status_code").between(200, 299) & http.is_html(F.col("content_type"))
    kind = F.coalesce(kind, F.when(ok_html & http.too_large(F.col("content_length"), F.col("body"), max_bytes), F.lit("too-large")))
    rows = responses.withColumn("kind", kind)
    wait = http.retry_wait_ms(F.when(F.col("kind").isNull(), F.col("status_code")), F.col("retry_after"), F.col("attempt"), F.lit(base_ms), F.lit(0))
    again = http.retryable(F.when(F.col("kind").isNull(), F.col("status_code")), F.col("kind")) & wait.isNotNull()
    rows = rows.withColumn("again", again)
    last = rows.groupBy("url").agg(F.max("attempt").alias("last"))
    stops = rows.where(~F.col("again")).groupBy("url").agg(F.min("attempt").alias("stop"))
    ends = last.join(stops, "url", "left").withColumn("attempts", F.least(F.coalesce("stop", F.lit(1 << 20)), F.lit(retry_count + 1)))
    ends = ends.withColumn("attempt", F.least("attempts", "last"))
    tries = ends.join(rows.withColumnRenamed("attempt", "script"), "url")
    # The last script stands for all attempts after it, whose waits grow on.
    tries = tries.withColumn("no", F.explode(F.when(F.col("script") == F.col("last"), F.sequence("script", F.greatest("script", "attempts"))).otherwise(F.array("script"))))
    tries = tries.where(F.col("no") <= F.col("attempts"))
    later = http.retry_wait_ms(F.when(F.col("kind").isNull(), F.col("status_code")), F.col("retry_after"), F.col("no"), F.lit(base_ms), F.lit(0))
    one = F.struct("no", F.col("status_code").cast("int").alias("status"), F.col("kind").alias("kind"), F.when(F.col("no") < F.col("attempts"), later).alias("wait"), took.alias("duration"))
    tries = tries.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(one)), lambda t: F.struct(t["status"].alias("status"), t["kind"].alias("kind"), t["wait"].alias("wait"), t["duration"].alias("duration"))).alias("tries"))
    return ends.select("url", "attempt", "attempts").join(rows, ["url", "attempt"]).join(tries, "url").withColumn("error_kind", F.col("kind"))


def robots_files(responses: DataFrame, retry_count: int = 2, base_ms: int = 500):
    """From scripted responses of robots.txt files, a function from a URL to what its attempts end in, or None."""
    settled = settle(responses, retry_count, base_ms, 512_000)

    def fetch(address: str) -> dict | None:
        row = settled.where(F.col("url") == address).select("status_code", "location", "body", "error_kind", "attempts").first()
        return None if row is None else row.asDict()

    return fetch


def web(responses: DataFrame, retry_count: int = 2, base_ms: int = 500, max_bytes: int = 1_000_000) -> DataFrame:
    """RESPONSES -> the stored web that the crawl reads: bodies are parsed once, and only links go on."""
    return parsed(settle(responses, retry_count, base_ms, max_bytes), max_bytes)


def parsed(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Settled responses with error_kind and attempts -> what the crawl reads."""
    good = F.col("error_kind").isNull() & F.col("status_code").between(200, 299) & http.is_html(F.col("content_type"))
    body = F.when(good, F.coalesce("body", F.lit("")))
    rows = rows.withColumn("page", F.when(good, html.read_html(body, F.col("url"))))
    broken = F.col("page.error").isNotNull()
    links = F.arrays_zip(F.col("page.links").alias("url"), _keys(F.col("page.links")).alias("key"))
    canonical = F.when(F.col("page.canonical").isNotNull(), url.resolve(F.col("page.canonical"), F.col("page.base")))
    message = F.when(F.col("error_code").isNotNull(), http.error_message(F.lit("fetch failed"), F.col("error_code"))).when(F.col("error_kind") == "too-large", F.lit(f"response exceeds {max_bytes} bytes")).when(broken, F.col("page.error"))
    return rows.select(
        "url", "status_code", "content_type", "location", F.coalesce("error_kind", F.when(broken, F.lit("parse"))).alias("error_kind"), message.alias("error_message"), "attempts", "tries",
        F.octet_length(body).cast("bigint").alias("byte_length"), http.content_hash(body).alias("sha"), links.alias("links"),
        canonical.alias("canonical_url"), url.exact_key(canonical).alias("canonical_key"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(links):
    from skein.functions import weburl

    return links.map(lambda urls: None if urls is None else [weburl.canonical_key(u) for u in urls])


def relational_site(spark: SparkSession, sf_dir: str) -> StoredWeb:
    """A stored web of four levels under https://site.test: regions, nations, customers, orders.

    An order's status says how its page answers: P 404, O plain text, F a page without links.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    page = lambda kind, key: F.concat(F.lit(f"{SITE}/{kind}/"), F.col(key))
    region, nation, customer, orders = map(read, ("region", "nation", "customer", "orders"))
    link = lambda rows, parent, child: rows.select(parent.alias("from_url"), F.lit(0).alias("n"), child.alias("url"), child.alias("key"))
    links = link(region, F.lit(f"{SITE}/"), page("r", "r_regionkey"))
    for rows, parent, child in ((nation, page("r", "n_regionkey"), page("n", "n_nationkey")), (customer, page("n", "c_nationkey"), page("c", "c_custkey")), (orders, page("c", "o_custkey"), page("o", "o_orderkey"))):
        links = links.unionByName(link(rows, parent, child))
    html_page = (F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"))
    urls = spark.range(1).select(F.lit(f"{SITE}/").alias("url"))
    for rows, at in ((region, page("r", "r_regionkey")), (nation, page("n", "n_nationkey")), (customer, page("c", "c_custkey"))):
        urls = urls.unionByName(rows.select(at.alias("url")))
    status = F.col("o_orderstatus")
    leaves = orders.select(page("o", "o_orderkey").alias("url"), F.when(status == "P", 404).otherwise(200).alias("status_code"), F.when(status == "O", "text/plain").otherwise("text/html").alias("content_type"))
    pages = urls.select("url", *html_page).unionByName(leaves)
    counted = links.groupBy(F.col("from_url").alias("url")).agg(F.count("*").cast("int").alias("n_links"))
    return StoredWeb(answered(pages).join(counted, "url", "left"), links)


def answered(pages: DataFrame, location: Column | None = None, sha: Column | None = None, canonical: Column | None = None) -> DataFrame:
    """url, status_code, content_type -> what the crawl reads of a page that answers at the first attempt; no links."""
    none = lambda kind: F.lit(None).cast(kind)
    fine = (F.col("status_code") == 200) & (F.col("content_type") == "text/html")
    declared = none("string") if canonical is None else canonical
    return pages.select(
        "url", "status_code", "content_type", (none("string") if location is None else location).alias("location"), none("string").alias("error_kind"), none("string").alias("error_message"),
        F.lit(1).alias("attempts"), F.when(fine, F.length("url")).cast("bigint").alias("byte_length"),
        F.sha2("url" if sha is None else sha, 256).alias("sha"), declared.alias("canonical_url"), declared.alias("canonical_key"),
    )


MAZE = "https://maze.test"


def maze(spark: SparkSession, sf_dir: str, kinds: tuple[int, ...]) -> StoredWeb:
    """A stored web of redirects, declared canonicals, repeated bodies and odd links under https://maze.test.

    The start links to a page for each customer whose key modulo 10 is one of kinds, which says how it
    answers: 0 a redirect to a page, 1 one to itself, 2 a chain of six, 3 one to another site, 4 one to
    the page of the customer four before, 5 a page that declares another one as canonical, 6 and 7 two
    pages of one body, 8 a redirect without a target, 9 a page with a link to another site, into a trap
    and to a page of its own.
    """
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")).withColumn("kind", (F.col("k") % 10).cast("int")).where(F.col("kind").isin(*kinds))
    at = lambda prefix, tail="": F.concat(F.lit(f"{MAZE}{prefix}"), F.col("k").cast("string"), F.lit(tail))
    kind, none = F.col("kind"), F.lit(None).cast("string")
    to = (
        F.when(kind == 0, at("/f/")).when(kind == 1, at("/c/")).when(kind == 2, at("/h/", "/1")).when(kind == 3, F.concat(F.lit("https://other.test/"), F.col("k").cast("string")))
        .when(kind == 4, F.concat(F.lit(f"{MAZE}/c/"), (F.col("k") - 4).cast("string")))
    )
    moved = kind.isin(0, 1, 2, 3, 4, 8)
    body = F.when(kind.isin(6, 7), F.concat(F.lit("twin "), (F.col("k") - kind).cast("string"))).otherwise(at("/c/"))
    pages = keys.select(at("/c/").alias("url"), F.when(moved, 302).otherwise(200).alias("status_code"), F.when(~moved, "text/html").alias("content_type"), to.alias("to"), body.alias("body"), F.when(kind == 5, at("/t/")).alias("canonical"))
    steps = keys.where("kind = 2").select("k", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i"))
    step = lambda i: F.concat(F.lit(f"{MAZE}/h/"), F.col("k").cast("string"), F.lit("/"), i.cast("string"))
    pages = pages.unionByName(steps.select(step(F.col("i")).alias("url"), F.lit(302).alias("status_code"), none.alias("content_type"), step(F.col("i") + 1).alias("to"), none.alias("body"), none.alias("canonical")))
    plain = keys.where("kind IN (0, 5, 9)").select(F.when(kind == 0, at("/f/")).when(kind == 5, at("/t/")).otherwise(at("/l/")).alias("url"))
    plain = plain.unionByName(spark.range(1).select(F.lit(f"{MAZE}/").alias("url")))
    pages = pages.unionByName(plain.select("url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), none.alias("to"), F.col("url").alias("body"), none.alias("canonical")))
    odd = F.array(F.concat(F.lit("https://other.test/x"), F.col("k").cast("string")), at("/a/a/a/"), at("/l/"))
    links = keys.select(F.lit(f"{MAZE}/").alias("from_url"), F.lit(0).alias("n"), at("/c/").alias("url"))
    links = links.unionByName(keys.where("kind = 9").select(at("/c/").alias("from_url"), F.posexplode(odd).alias("n", "url"))).withColumn("key", F.col("url"))
    counted = links.groupBy(F.col("from_url").alias("url")).agg(F.count("*").cast("int").alias("n_links"))
    return StoredWeb(answered(pages, F.col("to"), F.col("body"), F.col("canonical")).join(counted, "url", "left"), links)
