import json

import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.plans import crawl as engine
from skein.plans import report
from skein.plans.config import CrawlConfig
from skein.sources import ordered


@pytest.fixture(scope="module")
def result(spark):
    """3,000 pages in an order that isn't that of the rows, with nulls, commas, quotes and line ends."""
    kinds = dict(x.split() for x in engine.PAGES.split(", "))
    n = F.col("id")
    values = {
        "canonicalUrl": F.concat(F.lit("https://e.com/"), n), "requestedUrl": F.concat(F.lit("https://e.com/é,\""), n), "state": F.lit("failed"), "depth": F.lit(1), "attempts": F.lit(1),
        "errorMessage": F.when(n % 3 == 0, "a,\"b\"\nc").when(n % 3 == 1, ""), "statusCode": F.when(n % 2 == 0, 404),
    }
    pages = spark.range(3000).repartition(7).select(*(values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()), (n * 7919 % 3000).alias("created_ord"), F.lit(True).alias("reserved"))
    return engine.CrawlResult(CrawlConfig(start_url="https://e.com/"), pages, [{"origin": "https://e.com", "statusCode": None, "outcome": "allow-all", "errorKind": None}], "completed", 0, 5)


def test_parts_of_a_csv_report(spark, result, tmp_path):
    path = str(tmp_path / "csv")
    report.save(result, "csv", path)
    assert "\n".join(ordered.read(spark, path)) + "\n" == report.csv(result)
    with pytest.raises(FileExistsError):
        report.save(result, "csv", path)


def test_parts_of_a_json_report(spark, result, tmp_path):
    path = str(tmp_path / "json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts, though they are small
    try:
        report.save(result, "json", path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert json.loads("\n".join(ordered.read(spark, path))) == json.loads(report.to_json(result))
    parts = ordered.manifest(spark, path).orderBy("number").collect()
    assert len(parts) > 1 and sum(p.lines for p in parts) == 3002 and [p.part for p in parts] == sorted(p.part for p in parts)


def test_an_attempt_that_failed_is_written_again(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(5).select(F.col("id").cast("string")).write.text(path)  # no manifest
    lines = spark.range(100).select("id", F.concat(F.lit("line "), "id").alias("line"))
    ordered.write(lines, "id", "line", path)
    assert list(ordered.read(spark, path)) == [f"line {i}" for i in range(100)]


def test_empty_reports(spark, result, tmp_path):
    none = engine.CrawlResult(result.config, result.pages.limit(0), [], "completed", 0, 5)
    for kind in ("csv", "json"):
        report.save(none, kind, str(tmp_path / kind))
    assert list(ordered.read(spark, str(tmp_path / "csv"))) == [",".join(engine.COLUMNS)]
    assert json.loads("\n".join(ordered.read(spark, str(tmp_path / "json"))))["pages"] == []


def test_the_command_line_writes_folders(spark, result, tmp_path):
    import io

    out, err = io.StringIO(), io.StringIO()
    assert cli.run(["https://e.com/", "--format", "csv", "--output", f"{tmp_path}/report/"], out, err, crawl=lambda config, stopped: result) == 0
    assert "\n".join(ordered.read(spark, f"{tmp_path}/report")) + "\n" == report.csv(result) and "3000" in out.getvalue()
