"""Redirects to plain URLs, traps and schedules without Python and without doing the same again."""

from pyspark.sql import functions as F

from skein.functions import url, weburl


def test_targets_against_the_exact_functions(spark):
    """Plain and odd references: both columns are those of the exact parser; rows without a reference have neither."""
    refs = ["/a/b/?z=1&a=2#f", "../q", "https://other.test/x/", "http://u:p@h.test/", "ftp://h.test/x", "http://[", "", "//H.test:443/%7e", "?x=é", "http://ß.test/", "mailto:x", "/a//b/./c/..", None]
    rows = spark.createDataFrame([(i, r, "https://site.test/d/e?f=g") for i, r in enumerate(refs)], "i int, raw string, base string")
    got = {r.i: (r.to, r.key) for r in url.with_target(rows, "raw", "base", "to", "key").collect()}
    to = [None if r is None else weburl.resolve(r, "https://site.test/d/e?f=g") for r in refs]
    assert got == {i: (t, None if t is None else weburl.canonical_key(t)) for i, t in enumerate(to)}


def test_plain_targets_need_no_python(spark):
    rows = spark.createDataFrame([(i, f"/t/{i}" if i % 2 else None, "https://site.test/") for i in range(40)], "i int, raw string, base string")
    plan = url.with_target(rows, "raw", "base", "to", "key")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_a_trap_is_judged_by_one_look_at_the_path(spark):
    assert url.trap_reason(F.col("key"))._jc.toString().count("regexp_extract") == 1
