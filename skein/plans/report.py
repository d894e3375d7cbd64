"""Reports of a crawl: console summary, details, CSV, JSON, and where each goes.

Tables are made as DataFrames; only their finished lines come to the driver, which prints them. ``save``
writes CSV and JSON of any size as parts in a folder instead.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import html, http, url
from skein.plans.config import ConfigError, camel
from skein.plans.crawl import COLUMNS, CrawlResult, tally
from skein.sources import ordered

FORMATS = ("console", "json", "csv")
LABELS = ("reserved", "fetched", "ok", "skipped", "failed", "queued")
#: Fixed text of the details report.
NOTE = "URLs may be shortened for terminal display; use --format json or --format csv for complete values."


def block(title: str, rows: list[tuple[str, int]]) -> str:
    wide, digits = max(len(n) for n, _ in rows), max(len(str(c)) for _, c in rows)
    return "\n".join([title, *(f"  {n.ljust(wide)}  {str(c).rjust(digits)}" for n, c in rows)])


def console(result: CrawlResult) -> str:
    counts = result.counts().first().asDict()
    blocks = [f"{result.stop_reason} {result.config.start_url} {result.finished_ms - result.started_ms}ms", block("crawl", [(n, counts[n]) for n in LABELS])]
    for title, column in (("skipped", "skipReason"), ("failed", "errorKind")):
        rows = [tuple(r) for r in tally(result.pages, title, column).collect()]  # a closed vocabulary
        if rows:
            blocks.append(block(title, rows))
    if result.robots:
        lines = [f"  {r['origin']}  " + " ".join(str(x) for x in (r["outcome"], r["statusCode"], r["errorKind"]) if x is not None) for r in result.robots]
        blocks.append("\n".join(["robots", *lines]))
    return "\n\n".join(blocks) + "\n"


def ignored_lines(pages: DataFrame) -> DataFrame:
    """The columns of pages (url, html, ...) but html, and a debug line for each link of a page that is no candidate."""
    read = html.with_page(pages, "html", "url", "_page")
    rows = read.select(*(c for c in pages.columns if c != "html"), F.explode("_page.ignored").alias("_link"))
    return rows.withColumn("line", F.concat(F.lit("[debug] ignored "), F.col("_link.reason"), F.lit(" "), F.col("_link.raw"), F.lit(" base "), F.regexp_replace("url", r"[\r\n]+", " "))).drop("_link")


def details_rows(pages: DataFrame) -> DataFrame:
    """created_ord, line, shortened: the table's lines."""
    shown = pages.withColumn("shown", url.display_url(F.col("canonicalUrl")))
    width = shown.agg(F.greatest(F.lit(3), F.max(F.length("shown")))).first()[0] or 3
    cells = [F.rpad("state", 8, " "), F.rpad(http.status_cell(F.col("state"), F.col("statusCode")), 6, " "), F.rpad(F.col("depth").cast("string"), 5, " "), F.rpad("shown", width, " "), http.reason_cell(F.col("state"), F.col("skipReason"), F.col("errorKind"))]
    return shown.select("created_ord", F.concat(F.lit("  "), F.concat_ws("  ", *cells)).alias("line"), (F.length("canonicalUrl") > 64).alias("shortened"), F.lit(width).alias("width"))


def details(result: CrawlResult) -> str:
    rows = details_rows(result.pages).orderBy("created_ord").collect()
    width = rows[0]["width"] if rows else 3
    head = "  " + "  ".join(["STATE".ljust(8), "STATUS", "DEPTH", "URL".ljust(width), "REASON"])
    note = f"\n{NOTE}" if any(r["shortened"] for r in rows) else ""
    return console(result) + "\n" + "\n".join(["pages", head, *(r["line"] for r in rows)]) + note + "\n"


def csv_lines(pages: DataFrame) -> DataFrame:
    return pages.select("created_ord", http.csv_line(*(F.col(c) for c in COLUMNS)).alias("line"))


def csv(result: CrawlResult) -> str:
    return "\n".join([",".join(COLUMNS), *(r["line"] for r in csv_lines(result.pages).orderBy("created_ord").toLocalIterator())]) + "\n"


def _envelope(result: CrawlResult, pages: list[dict]) -> dict:
    iso = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return {
        "schemaVersion": 1, "startUrl": result.config.start_url, "startedAt": iso(result.started_ms), "finishedAt": iso(result.finished_ms),
        "durationMs": result.finished_ms - result.started_ms, "stopReason": result.stop_reason, "config": {camel(k): v for k, v in asdict(result.config).items()},
        "pages": pages, "robots": result.robots, "counts": result.counts().first().asDict(),
    }


def envelope(result: CrawlResult) -> dict:
    return _envelope(result, [r.asDict() for r in result.pages.orderBy("created_ord").select(*COLUMNS).toLocalIterator()])


def save(result: CrawlResult, format: str, path: str) -> None:
    """A CSV or JSON report of any size as numbered parts in a folder, in the order of creation; nulls are kept."""
    if format == "csv":
        ordered.write(csv_lines(result.pages), "created_ord", "line", path, head=",".join(COLUMNS))
        return
    if format != "json":
        raise ConfigError(f"No parts of format: {format}")
    head, tail = json.dumps(_envelope(result, []), ensure_ascii=False).split('"pages": []')
    first = result.pages.agg(F.min("created_ord")).first()[0]
    page = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    lines = result.pages.select("created_ord", F.concat(F.when(F.col("created_ord") == first, "").otherwise(","), page).alias("line"))
    ordered.write(lines, "created_ord", "line", path, head=f'{head}"pages": [', tail=f"]{tail}")


def to_json(result: CrawlResult) -> str:
    return json.dumps(envelope(result), indent=2, ensure_ascii=False) + "\n"


def normalize_format(name: str | None) -> str:
    if name is None:
        return "console"
    if name not in FORMATS:
        raise ConfigError(f"Unknown format: {name}")
    return name


def render(result: CrawlResult, format: str | None = None, output: str | None = None, with_details: bool = False, trace: str = "") -> dict:
    """stdout, stderr and file (path, text) of a report: with a file or console format, people read stdout."""
    chosen = normalize_format(format)
    summary = console(result)
    human = details(result) if with_details and chosen == "console" else summary
    machine = {"console": lambda _: human, "csv": csv, "json": to_json}[chosen](result)
    people = bool(output) or chosen == "console"
    return {"stdout": human if people else machine, "stderr": ("" if people else summary) + trace, "file": (output, machine) if output else None}
