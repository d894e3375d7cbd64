import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import html, http, url, weburl
from skein.functions.markup import Head
from skein.operators import robots, robots_table
from skein.plans.config import ConfigError, CrawlConfig, from_options

KEYS = [
    ("https://Example.com", "https://example.com/"), ("http://e.com:80/a/", "http://e.com/a"), ("https://e.com:443/a//", "https://e.com/a"), ("http://e.com:443/x", "http://e.com:443/x"),
    ("https://e.com/?b=2&a=1", "https://e.com/?a=1&b=2"), ("https://e.com/a?q=b a", "https://e.com/a?q=b+a"), ("https://e.com/p?~x=1&a", "https://e.com/p?a=&%7Ex=1"),
    ("https://e.com/A?q=%7e&&#f", "https://e.com/A?q=%7E"), ("https://e.com/?a=2&a=1", "https://e.com/?a=1&a=2"), ("mailto:a@b.c", None), ("https://u:p@e.com/", None),
]


def test_canonical_key_native_and_exact_agree(spark):
    rows = spark.createDataFrame(KEYS, "u string, want string").select("u", "want", url.canonical_key(F.col("u")).alias("k")).collect()
    for r in rows:
        assert r.k == r.want == weburl.canonical_key(r.u)
        assert r.k is None or weburl.canonical_key(r.k) == r.k


@pytest.mark.parametrize("raw, want", [("../x?y#z", "https://e.com/a/x?y"), ("//h.com", "https://h.com/"), ("?q=1", "https://e.com/a/b/c?q=1"), ("./d", "https://e.com/a/b/d"),
                                       ("http://[", None), ("HTTP://E.com:80/é", "http://e.com/%C3%A9"), ("/a/./b/../c", "https://e.com/a/c"), ("http://0x7f.1/", "http://127.0.0.1/")])
def test_resolve(raw, want):
    assert weburl.resolve(raw, "https://e.com/a/b/c") == want


def test_html():
    page = html.read('<base href="/dir/"><link rel="x CANONICAL" href="/c"><a href=p>1</a><a href=" ">2</a><a href="mailto:x">3</a><!-- <a href=no> --><script>"<a href=no>"</script><a href="p#f">4</a>', "https://e.com/")
    assert page["links"] == ["https://e.com/dir/p", "https://e.com/dir/p"]
    assert page["canonical"] == "/c" and page["ignored"] == [{"reason": "scheme", "raw": "mailto:x"}]


def test_http_rules(spark):
    row = spark.range(1).select(
        http.is_html(F.lit("Text/HTML; x")).alias("html"), http.backoff_ms(F.lit(5), F.lit(500)).alias("b"), http.retry_wait_ms(F.lit(503), F.lit("9"), F.lit(1), F.lit(500), F.lit(0)).alias("w"),
        http.retry_after_ms(F.lit("Thu, 01 Jan 1970 00:00:03 GMT"), F.lit(1000)).alias("ra"), http.csv_cell(F.lit('a"b')).alias("c"), http.trace_line("take", url=F.lit("a b"), depth=F.lit(1)).alias("t"),
    ).first()
    assert (row.html, row.b, row.w, row.ra, row.c, row.t) == (True, 5000, None, 2000, '"a""b"', '[trace] take url="a b" depth=1')


def test_robots_groups():
    text = "User-agent: *\nDisallow: /private\n\nUser-agent: SkeinBot\nDisallow: /secret\nAllow: /secret/public\nCrawl-delay: 2\n"
    own = robots.parse(text, "skeinbot")
    assert own.delay == 2 and [robots.allowed_path(p, own.rules) for p in ("/secret", "/secret/public", "/private")] == [False, True, True]
    assert not robots.allowed_path("/private", robots.parse(text, "other").rules)


def test_config():
    assert CrawlConfig(start_url="https://e.com").max_pages == 50
    for options, message in (({}, "startUrl is required"), ({"startUrl": "ftp://x"}, "startUrl must be"), ({"startUrl": "http://e.com", "maxPages": 0}, "maxPages must be a positive integer"), ({"x": 1}, "Unknown config key: x")):
        with pytest.raises(ConfigError, match=message):
            from_options(options)


def test_trace_lines_of_all_pages(spark):
    from skein.operators.registered import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r.line for r in QUERIES["q_trace_lines"](spark, sf).collect()}
    shown = lambda u: u if re.fullmatch(r"[A-Za-z0-9._:/-]+", u) else json.dumps(re.sub(r"[\r\n]+", " ", u), ensure_ascii=False)
    assert not any("@" in r.url for r in pages) and any(shown(r.url) != r.url for r in pages)
    assert got == {r.page_id: f"[trace] take url={shown(r.url)} depth={r.page_id % 3} sequence={r.page_id}" for r in pages}


def test_dates_in_any_session_zone(spark):
    """A wait is the same whatever the session's zone, for all three forms of a date."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    headers = ["Thu, 01 Jan 1970 00:00:03 GMT", "Thursday, 01-Jan-70 00:00:03 GMT", "Thu Jan  1 00:00:03 1970", "tomorrow", "Thu, 01 Foo 1970 00:00:03 GMT"]
    try:
        for name in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "n int, h string").select("n", http.retry_after_ms(F.col("h"), F.lit(1000)).alias("w")).collect()
            assert [r.w for r in sorted(got)] == [2000, 2000, 2000, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_product_tokens():
    for agent, want in (("SkeinBot/1.0", "SkeinBot"), ("A b/2", "A"), ("/x", ""), (" x", ""), ("plain", "plain")):
        assert robots.product_token(agent) == want


def test_hosts_beyond_ascii():
    for host, want in (("faß.de", "xn--fa-hia.de"), ("BÜCHER.example", "xn--bcher-kva.example"), ("βόλος.com", "xn--nxasmm1c.com"), ("ａ.de", "a.de")):
        assert weburl.canonical_key(f"http://{host}/") == f"http://{want}/"


def test_lines_of_robots_files():
    """Only CR and LF end a line."""
    assert robots.parse("User-agent: *\u2028Disallow: /no\x0b\rDisallow: /a\nDisallow: /b\r\nDisallow: /c", "x").rules == []
    assert robots.parse("User-agent: *\rDisallow: /a\u2028b\nDisallow: /b\r\nAllow: /c", "x").rules == [(False, "/a\u2028b"), (False, "/b"), (True, "/c")]


def test_very_many_robots_rules(spark):
    """40,000 rules decide as a loop over all of them does, and few rules as many."""
    import random

    r = random.Random(2)
    rules = [(r.random() < 0.3, "/" + "".join(r.choice("ab/*") for _ in range(r.randint(1, 7))) + ("$" if r.random() < 0.1 else "")) for _ in range(40000)]
    paths = ["/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 12))) for _ in range(60)]

    def slowly(path, some):
        best = (0, True)
        for allow, p in some:
            if re.match(robots.regex_of(p), path):
                best = max(best, (len(p), allow))
        return best[1]

    rows = spark.createDataFrame([(i, f"https://e.test{p}") for i, p in enumerate(paths)], "n int, u string")
    few = [x for x in rules if len(x[1]) > 4][:50]
    with pytest.raises(ValueError, match="too many"):
        robots.allowed(F.col("u"), rules)
    table = robots_table.prepared(spark.createDataFrame([("https://e.test", *x) for x in rules], "origin string, allow boolean, pattern string"))
    for some, decided in ((rules, robots_table.decide(rows, table, "u", "a")), (few, rows.select("n", robots.allowed(F.col("u"), few).alias("a")))):
        got = {x.n: x.a for x in decided.collect()}
        assert got == {i: slowly(p, list(dict.fromkeys(some))) for i, p in enumerate(paths)}


def test_hrefs_of_any_markup(spark):
    """The pattern and the tokenizer agree on every page; odd ones go to the tokenizer."""
    pages = ["<a href=\"/a\">x</a><A class=b HREF = \"/b\">", "<!-- <a href=\"/no\"> --><a href=\"/a\">", "<script>'<a href=\"/no\">'</script><a href=\"/a\">", "<a href='/a'><a href=/b>", "<a href=\"/a?x=1&amp;y=2\">",
             "<title><a href=\"/no\"></title><a href=\"/a\">", "<title>plain</title><a href=\"/a\"><a href=\" \">", "<a data-x='<a href=\"/no\">' href=\"/a\">", "", "<template><a href=\"/no\"></template>", "<a href=\"/a\" href=\"/b\">"]
    pages += [x.html for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    r = random.Random(5)
    bits = ["<a href=x>", '<a href="/q">', '<a class="b" href="/r">', '<a title="x href=" href="/s">', "<a ", "<!-- c -->", "<!--", "-->", "<!-->", "--!>", "<script>", "</script>", "</script x>", "<style>", "</style >", "<title>", "</title>",
            "<template>", "</template>", "text", "<", "</", "<br/>", '<base href="/b/">', ">", '"', "'", "=", "<!doctype html>", "<![CDATA[x]]>", "<?pi?>", '<p class="a">', '<p class=b" c=">', "&lt;", '<a href="/t?a&amp;b">', '<a href="/u?a&copy=b">', "<plaintext>", "\x0b"]
    pages += ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(i, p, f"https://e.com/{i}") for i, p in enumerate(pages)], "n int, p string, u string")
    got = {i: [] for i in range(len(pages))}
    for x in html.with_links(rows, "p", "u", ["n"]).orderBy("n", "pos").collect():
        assert x.pos == len(got[x.n])
        got[x.n].append((x.raw, x.base))
    for i, page in enumerate(pages):
        own = Head(page)
        base = f"https://e.com/{i}" if not (own.base or "").strip() else weburl.resolve(own.base, f"https://e.com/{i}")
        assert got[i] == [(h, base) for h in own.hrefs], page[:200]


def test_plain_pages_stay_in_the_jvm(spark):
    """The pages table has no page that needs the tokenizer, so none of its plans has Python."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    links = html.with_links(pages, "html", "url", ["page_id"])
    plan = url.with_key(url.with_resolved(links, "raw", "base", "link"), "link", "key")._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_tokenizer_is_linear():
    """A megabyte of what isn't closed, or closed late."""
    for part in ("<a ", '<a href="', "<a x='", "<!--", "<!", "</", "</a ", "<script>", "<script><!--<script>", "<", "<title>", "&amp", "<a href=&amp", "<a&#1"):
        page = part * (1_000_000 // len(part))
        began = time.process_time()
        Head(page)
        assert time.process_time() - began < 4, part


def test_tokenizer():
    heads = {
        "<a href=x>": ["x"], "<A HREF = 'y z'>": ["y z"], "<a/href=s>": ["s"], "<a href='1' href='2'>": ["1"], "<a href>": [], "<a href=' '>": [], "<a href=x": [], "<!--><a href=1>": ["1"], "<!---><a href=1>": ["1"],
        "<!-- --!><a href=1>": ["1"], "<!-- <a href=1>": [], "<script><!--<script></script><a href=1>--></script><a href=2>": ["2"], "<script><!--</script><a href=1>": ["1"], "<script>'</scripty><a href=1>'</script ><a href=2>": ["2"],
        "<title></b><a href=1></title><a href=2>": ["2"], "<textarea><a href=1>": [], "<plaintext><a href=1>": [], "<template><template></template><a href=1></template><a href=2>": ["2"], "</template><a href=1>": ["1"],
        "<a href='?a&amp;b&copy;&copy=1&copyx&#65;&#x42&notit;&amp'>": ["?a&b\u00a9&copy=1&copyxAB&notit;&"], "<a =x href=1>": ["1"], "<a b=c'd href=1>": ["1"], "<a b='>' href=1>": ["1"], "a < b <a href=1>": ["1"], "</ <a href=1>><a href=2>": ["2"],
    }
    for page, hrefs in heads.items():
        assert Head(page).hrefs == hrefs, page


def test_references_of_any_form(spark, monkeypatch):
    """Expressions resolve plain hosts as the exact function does; few rows need it."""
    r = random.Random(3)
    bases = ["https://Example.com/dir/page?x=1#f", "http://e.com:80", "https://e.com:8443/a/b/../c", "http://h.test/a b/%zz", "https://u:p@e.com/x", "http://e.com//a//b", "https://e.com?q", "http://127.0.0.1/x", "https://b\u00fccher.de/a",
             "ftp://f.com/a", "https://e.com/./a/%2e%2E/b/", "mailto:x", "", "https://e.com/a?b?c", "https://e_x.com./a", "http:/e.com/a", "https:e.com/b"]
    bits = ["..", ".", "/", "//", "?", "#", "a", "b c", "%2e", "%2E%2e", "\u00e9", "\u6f22", "\U0001f600", "\\", "h.test", "http:", "https:", "HTTPS:", "ftp:", "mailto:", "x@", "u:p@", ":", "80", "443", ":8080", "=", "&", "'", '"', "<", ">",
            "`", "{", "}", "^", "|", "[", "]", "\t", "\n", " ", "%", "%C3", "+", "~", "javascript:", "0x7f", "1.2.3.4", "xn--a", ".com", "e.com"]
    cases = [(r.choice(bases), "".join(r.choice(bits) for _ in range(r.randint(0, 7)))) for _ in range(4000)] + [(None, "x"), ("https://e.com/", None)]
    cases += [(b, x) for b in bases for x in ["x", "./y", "../z?q#f", "//h.test/w", "?a=1", "#top", "", "https://o.test", "a/../b", "/../c", "mailto:m@n", "//h.test:443/x", "https:x/y", "http:x", "/a/./b/..", "..", "../../..", ".", "//u@h/", "https://h:99999/", " x "]]
    df = spark.createDataFrame([(i, b, x) for i, (b, x) in enumerate(cases)], "i int, base string, raw string")
    want = [None if b is None or x is None else weburl.resolve(x, b) for b, x in cases]
    assert {x.i: x.u for x in url.with_resolved(df, "raw", "base", "u").collect()} == dict(enumerate(want))
    monkeypatch.setattr(url, "resolve", lambda raw, base: F.lit("odd"))
    mine = [i for i, b in enumerate(bases) if b.startswith("http") and "127" not in b and b.isascii()]
    own = url.with_resolved(df.where(F.col("base").isin([bases[i] for i in mine])), "raw", "base", "u").collect()
    assert sum(x.u == "odd" for x in own) < 0.35 * len(own) and all(x.u in ("odd", want[x.i]) for x in own)


def test_very_long_urls(spark):
    """Hundreds of thousands of characters in any part: no pattern recurses by the character."""
    n = 100_000
    long = ["https://e.com/?q=" + "a" * n, "https://e.com/?" + "a=1&" * n, "https://e.com/?" + "%41" * n, "https://e.com/?" + "%zz" * n, "https://e.com/" + "a/" * n, "https://e.com/" + "/" * n + "x", "https://e.com/" + "/" * n, "https://e.com/" + "x" * n + "#" + "y" * n,
            "https://" + "a." * n + "com/", "https://e.com:" + "1" * n + "/", "https://e.com/" + "../" * 3000, "x" * n, "https://e.com/" + "%" * n]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(long)], "i int, u string")
    got = url.with_key(rows, "u", "key").withColumn("same", url.canonical_key(F.col("u"))).collect()
    for x in got:
        assert x.key == x.same == weburl.canonical_key(x.u)
    reasons = {x.i: x.r for x in rows.select("i", url.trap_reason(F.col("u")).alias("r")).collect()}
    assert all(reasons[i] == "url-length" for i in range(len(long)))
    base = rows.withColumn("base", F.lit("https://e.com/d/p"))
    assert all(x.to == weburl.resolve(x.u, x.base) for x in url.with_resolved(base, "u", "base", "to").collect())


def test_starts_of_a_hot_origin(spark):
    """Most requests are of one origin, which lies over all partitions; starts are those of a loop."""
    import random

    from skein.operators import politeness

    r = random.Random(3)
    rows = [(r.choice(["hot"] * 9 + ["a", "b", None]), r.randrange(200000), i, r.choice([100, 200, 500])) for i in range(3000)]
    df = spark.createDataFrame(rows, "origin string, ready bigint, id int, gap bigint").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.id: x.start_ms for x in politeness.start_times(df, "origin", "ready", F.col("gap"), ["ready", "id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for origin in {x[0] for x in rows}:
        last = before = None
        for _, ready, i, gap in sorted((x for x in rows if x[0] == origin), key=lambda x: x[1:3]):
            last = ready if last is None else max(ready, last + max(before, gap))
            before = gap
            assert got[i] == last


def test_malformed_markup():
    """Markup that no parser likes is read as far as it goes; what breaks the reader is that page's own failure."""
    links = lambda body: html.read(body, "https://e.com/")["links"]
    for body in ("<![foo[x]]><a href=/b>", "<![if x]><a href=/b>", "<![endif]--><a href=/b>", "<!x><a href=/b>", "<?php ?><a href=/b>", "</ ><a href=/b>", "<a href=/b", "<a href=/b>&#xFFFFFFFF;&bogus;"):
        assert links(body) in (["https://e.com/b"], []) and html.read(body, "https://e.com/")["error"] is None
    assert links("<![foo[x]]><a href=/b>") == ["https://e.com/b"]
    assert html.read("<a href=x>", None)["error"]
