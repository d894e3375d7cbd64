import random
import re

import pytest

from skein.operators import robots, robots_table
from skein.operators.robots import parse

ANSWERS = "url string, status_code int, location string, error_kind string, body string, attempts int"
BODY = "User-agent: *\nDisallow: /x\nCrawl-delay: 3\n"


def looked_up(spark, answers):
    """robots_table.records and the one-by-one loader must agree on every origin asked."""
    origins = sorted({re.match("https?://[^/]*", a[0])[0] for a in answers if not a[0].startswith("https://cdn.")} | {"https://none.test"})
    table = spark.createDataFrame([(*a, 1) for a in answers], ANSWERS)
    got = {r.origin: r for r in robots_table.records(spark.createDataFrame([(o,) for o in origins], "origin string"), table).collect()}
    by = {a[0]: dict(zip(("url", "status_code", "location", "error_kind", "body"), a)) | {"attempts": 1} for a in answers}
    for o in origins:
        one = robots.load(o, "skein", True, by.get)
        assert (got[o].outcome, got[o].status_code, got[o].error_kind, got[o].attempts) == (one.outcome, one.status, one.error, one.attempts), o
        assert (got[o].body is not None) == (one.outcome == "parsed")
    return got


def chain(origin, n, host="https://cdn.test/c"):
    return [(f"{origin}/robots.txt", 302, f"{host}1", None, None), *((f"{host}{k}", 302, f"{host}{k + 1}", None, None) for k in range(1, n)), (f"{host}{n}", 200, None, None, BODY)]


def test_records_over_redirects(spark):
    answers = [
        ("https://a.test/robots.txt", 200, None, None, BODY), ("https://b.test/robots.txt", 404, None, None, None), ("https://c.test/robots.txt", 429, None, None, None), ("https://d.test/robots.txt", 503, None, None, None),
        ("https://e.test/robots.txt", None, None, "timeout", None), *chain("https://f.test", 5), *chain("https://g.test", 6, "https://cdn.other/"), ("https://h.test/robots.txt", 302, "/again", None, None), ("https://h.test/again", 302, "/robots.txt", None, None),
        ("https://i.test/robots.txt", 302, None, None, None), ("https://j.test/robots.txt", 302, "", None, None), ("https://k.test/robots.txt", 302, "ftp://x.test/", None, None), ("https://l.test/robots.txt", 302, "http://u:p@x.test/", None, None),
        ("https://m.test/robots.txt", 302, "http://[", None, None), ("https://n.test/robots.txt", 200, None, None, None), ("https://o.test/robots.txt", 200, None, None, "#" * 512001), ("https://p.test/robots.txt", 302, "//cdn.test/./x/../c3#f", None, None),
        ("https://q.test/robots.txt", 302, "/robots.txt", None, None), ("https://r.test/robots.txt", 304, None, None, None),
    ]
    got = looked_up(spark, answers)
    assert got["https://f.test"].hops == 5 and got["https://g.test"].error_kind == "redirect-limit" and got["https://h.test"].error_kind == "redirect-loop" and got["https://none.test"].outcome == "allow-all"


def test_newest_answers(spark):
    rows = [("u", 1, 200, "a"), ("u", 3, 404, "b"), ("u", 2, 500, "c"), ("v", 1, 200, "d"), ("v", 1, 200, "e")]
    got = robots_table.newest(spark.createDataFrame(rows, "url string, answered int, status_code int, body string")).collect()
    assert sorted(map(tuple, got)) == [("u", 404, "b"), ("v", 200, "e")]


def test_rules_and_gaps(spark):
    bodies = {"https://a.test": "User-agent: skein\nDisallow: /s\nAllow: /s/p\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /private\n", "https://b.test": BODY, "https://c.test": "", "https://d.test": "User-agent: *\nCrawl-delay: 30\n", "https://e.test": "User-agent: *\nCrawl-delay: 0.1\nDisallow:\n"}
    records = spark.createDataFrame([(o, b, "parsed") for o, b in bodies.items()] + [("https://f.test", None, "unavailable")], "origin string, body string, outcome string")
    rules = robots_table.rules(records, "Skein")
    assert sorted((r.origin, r.allow, r.pattern) for r in rules.where("pattern IS NOT NULL").collect()) == sorted((o, a, p) for o, b in bodies.items() for a, p in parse(b, "skein").rules)
    assert {r.origin[8]: r.gap_ms for r in robots_table.gaps(records, rules, 200).collect()} == {"a": 2000, "b": 3000, "c": 200, "d": 10000, "e": 200, "f": 200}


def matched(rules, rows):
    by, out = {}, []
    for o, allow, p in rules:
        by.setdefault(o, []).append((allow, p))
    own = {o: robots.Matcher(v) for o, v in by.items()}
    for i, u in rows:
        m = re.match("(https?://[^/?#]*)([^#]*)", u or "")
        out.append((i, own[m[1]].allows(m[2] if m[2].startswith("/") else "/" + m[2]) if m and m[1] in own else True))
    return sorted(out)


def test_longest_match_against_the_matcher(spark):
    r = random.Random(4)
    bits = ["/", "a", "b", "/x", "*", "$", "?q=1", ".pdf", "\\E", "(", "é", "%20"]
    rules = [(f"https://o{i % 7}.test", r.random() < 0.5, "/" + "".join(r.choice(bits) for _ in range(r.randint(0, 6)))) for i in range(400)]
    rows = [(i, f"https://o{r.randrange(9)}.test" + r.choice(["", "/"]) + "".join(r.choice([*bits, "#f"]) for _ in range(r.randint(0, 8)))) for i in range(3000)]
    rows += [(3000, None), (3001, "mailto:x"), (3002, "https://o1.test/a"), (3002, "https://o1.test/a")]
    table = robots_table.prepared(spark.createDataFrame(rules, "origin string, allow boolean, pattern string"))
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "i int, url string, origin string, n int")
    got = robots_table.decide(df, table, "url")
    assert got.columns == [*df.columns, "allowed"]
    assert sorted((x.i, x.allowed) for x in got.collect()) == matched(rules, rows)
    assert robots_table.decide(df.limit(0), table, "url").count() == 0 and robots_table.decide(df, table.limit(0), "url").where("NOT allowed").count() == 0


def test_many_rules_of_one_origin(spark):
    """Tens of thousands of rules, no Python in the plan that joins them, no expression that grows with them."""
    rules = [("https://e.test", i % 2 == 0, f"/p{i}" + ("*z" if i % 10 == 0 else "")) for i in range(30000)] + [("https://e.test", False, "/")]
    rows = [(i, f"https://e.test/p{i}/xz") for i in range(0, 40000, 7)]
    table = robots_table.prepared(spark.createDataFrame(rules, "origin string, allow boolean, pattern string"))
    got = robots_table.decide(spark.createDataFrame(rows, "i int, url string"), table, "url")
    assert sorted((x.i, x.allowed) for x in got.collect()) == matched(rules, rows)


@pytest.mark.parametrize("columns", [["i", "url"], ["a.b", "__x"]])
def test_no_rules_allow(spark, columns):
    df = spark.createDataFrame([("x", "https://e.test/")], ", ".join(f"`{c}` string" for c in columns))
    empty = spark.createDataFrame([], "origin string, allow boolean, pattern string")
    at = "url" if "url" in columns else "__x"
    assert [r.allowed for r in robots_table.decide(df, robots_table.prepared(empty), at).collect()] == [True]
