from skein.plans import report
from skein.plans.config import CrawlConfig
from skein.plans.crawl import crawl
from skein.sources import site


def response(path, status=200, kind="text/html", location=None, body="", error=None, attempt=1):
    return ("http://e.com" + path, attempt, status, kind, location, None, None, body, error)


def run(spark, rows, robots=None, **config):
    web = site.web(spark.createDataFrame(rows, site.RESPONSES))
    return crawl(spark, CrawlConfig(start_url="http://e.com", **config), web, robots)


def test_order_limits_duplicates_and_redirects(spark):
    result = run(spark, [
        response("/", body='<a href="/c">c</a><a href=/b>b</a><a href="/r">r</a><a href="http://o.com/">o</a>'), response("/b", body='<a href="/x">x</a><a href="/y">y</a> b'),
        response("/c", body="<a href=/x>x</a><a href=/z>z</a>"), response("/r", 302, location="/b"), response("/x", body="dup"), response("/y", body="dup")], max_pages=6)
    rows = [(r.canonicalUrl[12:], r.discoveredFrom and r.discoveredFrom[12:], r.skipReason or r.state) for r in result.pages.orderBy("created_ord").collect()]
    assert rows == [("/", None, "ok"), ("/b", "/", "ok"), ("/c", "/", "ok"), ("/r", "/", "duplicate"), ("/", "/", "other-origin"), ("/x", "/b", "ok"), ("/y", "/b", "duplicate-content"), ("/z", "/c", "page-limit")]
    assert "duplicate-content  1" in report.console(result) and report.csv(result).startswith("canonicalUrl,requestedUrl")


def test_robots_and_errors(spark):
    robots = {"http://e.com/robots.txt": {"status_code": 200, "body": "User-agent: *\nDisallow: /s"}}
    result = run(spark, [response("/", body="<a href=/s>s</a><a href=/m>m</a><a href=/t>t</a>"), response("/t", kind="text/plain")], robots, max_depth=1)
    assert {(r.canonicalUrl[12:], r.skipReason or r.errorKind or r.state) for r in result.pages.collect()} == {("/", "ok"), ("/s", "robots"), ("/m", "http-status"), ("/t", "non-html")}


def test_the_web_is_not_moved(spark):
    """A generation is joined to buckets: neither the pages nor the links of the web are exchanged again."""
    from skein.sources.stored import stored

    web = stored(site.relational_site(spark, "/root/testdata/sf0.001"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.range(1000).selectExpr("concat('https://site.test/c/', id) url")
        for table, key in ((web.pages, "url"), (web.links, "from_url")):
            joined = frontier.withColumnRenamed("url", key).join(table, key)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        web.drop()


def test_redirects_with_user_names_are_bad(spark):
    result = run(spark, [response("/", body="<a href=/a>a</a><a href=/b>b</a><a href=/c>c</a>"), response("/a", 302, location="ftp://u@h/"), response("/b", 302, location="ftp://h/"), response("/c", 302, location="http://u@e.com/")])
    rows = {r.canonicalUrl[12:]: (r.skipReason or r.errorKind, r.errorMessage) for r in result.pages.collect()}
    assert rows["/a"] == rows["/c"] == ("bad-redirect", "redirect location contains userinfo") and rows["/b"] == ("redirect-off-origin", None)


def test_clock_and_time_budget(spark):
    """A stored crawl's time is that of its answers; the report's times come from the clock that is handed in."""
    times = iter(range(0, 10**6, 3))
    pages = [response("/", body="<a href=/a>a</a><a href=/b>b</a>"), response("/a", body="<a href=/c>c</a>"), response("/b", body="x"), response("/c", body="y")]
    scripts = spark.createDataFrame([(*p, 1500) for p in pages], site.RESPONSES + ", duration_ms bigint")
    for most, want in ((2000, "ok ok queued queued"), (10**6, "ok ok ok ok")):
        result = crawl(spark, CrawlConfig(start_url="http://e.com", max_duration_ms=most, respect_robots=False), site.web(scripts), None, clock=lambda: next(times))
        assert " ".join(r.state for r in result.pages.orderBy("created_ord").collect()) == want
        assert result.stop_reason == ("completed" if most == 10**6 else "budget") and result.finished_ms == result.started_ms + 3000
    assert [(r.waitedMs, r.durationMs) for r in result.pages.orderBy("created_ord").collect()] == [(0, 1500)] * 4


def test_a_live_web_and_its_clock(spark):
    """A live crawl looks at the clock before each generation."""
    times = iter((0, 1, 5, 6))

    def live(urls):
        return site.web(spark.createDataFrame([response("/", body="<a href=/a>a</a>")], site.RESPONSES))

    result = crawl(spark, CrawlConfig(start_url="http://e.com", max_duration_ms=4000, respect_robots=False), live, clock=lambda: next(times))
    assert [(r.canonicalUrl[12:], r.state) for r in result.pages.orderBy("created_ord").collect()] == [("/", "ok"), ("/a", "queued")] and result.stop_reason == "budget"


def test_retries_in_times_and_trace(spark):
    from skein.plans import trace

    rows = [response("/", 503), response("/", 500, attempt=2), response("/", body="x", attempt=3)]
    result = run(spark, rows, respect_robots=False, min_interval_ms=100)
    page = result.pages.first()
    assert (page.attempts, page.waitedMs, page.durationMs) == (3, 0, 1500)
    lines = trace.text(result).splitlines()
    assert [x for x in lines if " retry " in x] == ["[trace] retry url=http://e.com/ next=2 wait=500 status=503", "[trace] retry url=http://e.com/ next=3 wait=1000 status=500"]
    assert [x.split()[1] for x in lines] == ["crawl-start", "reserved", "take", "robots-check", "attempt-start", "retry", "attempt-start", "retry", "attempt-start", "links", "commit", "crawl-stop"]


def test_a_fatal_error_ends_the_crawl(spark):
    import pytest

    def web(urls):
        raise RuntimeError("no web")

    with pytest.raises(RuntimeError, match="no web"):
        crawl(spark, CrawlConfig(start_url="http://e.com"), web)


def test_second_interrupt_leaves_at_once():
    import io
    import os
    import signal

    from skein import cli

    codes = []

    def pressed_twice(config, stopped):
        stopped()
        for _ in range(2):
            os.kill(os.getpid(), signal.SIGINT)
        assert stopped()

    assert cli.run(["http://e.com"], io.StringIO(), io.StringIO(), pressed_twice, exit_now=codes.append) == 130
    assert codes == [130]
    assert cli.run(["http://e.com"], io.StringIO(), err := io.StringIO(), lambda *_: 1 / 0) == 1 and "division" in err.getvalue()
