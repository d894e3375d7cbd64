"""Command line: python -m skein URL [flags]. Exit codes: 0, 1 failed, 2 wrong flags, 130 second interrupt."""

from __future__ import annotations

import argparse
import os
import re
import signal
import sys

from skein.plans.config import ConfigError, from_options

#: flag, config key, text
NUMBERS = [
    ("--depth", "maxDepth", "deepest page depth, the start being 0 (2)"), ("--max-pages", "maxPages", "URLs reserved at most, the start included (50)"),
    ("--concurrency", "concurrency", "open requests at most; results are those of one worker (5)"), ("--per-origin", "perOriginLimit", "open requests on an origin (2)"),
    ("--min-interval", "minIntervalMs", "ms between request starts on an origin (200)"), ("--timeout", "timeoutMs", "ms for one attempt (10000)"),
    ("--max-duration", "maxDurationMs", "ms after which no generation begins (off)"), ("--max-attempts", "maxTotalAttempts", "HTTP attempts at most (off)"),
    ("--max-url-length", "maxUrlLength", "longest key that is fetched (2048)"), ("--max-path-depth", "maxPathDepth", "most path segments (16)"),
    ("--max-segment-repeats", "maxSegmentRepeats", "how often a path may repeat a segment (2)"),
]
SWITCHES = [("--no-respect-robots", "respectRobots", "don't read robots.txt"), ("--no-dedupe-content", "dedupeContent", "follow links of repeated bodies too"), ("--no-canonical", "respectCanonical", "ignore rel=canonical")]
_ZERO = ("maxDepth", "minIntervalMs")


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise ConfigError(message)


def parser() -> argparse.ArgumentParser:
    out = _Parser(prog="python -m skein", allow_abbrev=False, add_help=False)
    out.add_argument("url", nargs="*", help="one http or https URL without user name or password")
    for flag, key, text in NUMBERS:
        out.add_argument(flag, dest=key, metavar="N", help=text)
    out.add_argument("--user-agent", dest="userAgent", metavar="TEXT", help="User-Agent header")
    for flag, key, text in SWITCHES:
        out.add_argument(flag, dest=key, action="store_const", const=False, help=text)
    out.add_argument("--format", metavar="NAME", help="console, json or csv (console)")
    out.add_argument("--output", metavar="PATH", help="write the report to a file, or csv and json as parts to a folder if PATH ends in /")
    for flag, text in (("--details", "add the table of pages (console)"), ("--trace", "event lines on stderr")):
        out.add_argument(flag, action="store_true", help=text)
    out.add_argument("-h", "--help", action="store_true", help="show this text")
    return out


def invocation(argv: list[str]):
    """(config, format, output, details, trace), or None for help."""
    from skein.plans.report import normalize_format

    given = parser().parse_intermixed_args(argv)
    if given.help:
        return None
    if len(given.url) > 1:
        raise ConfigError("Expected one URL")
    options = {"startUrl": given.url[0]} if given.url else {}
    for _, key, _ in NUMBERS:
        if (raw := getattr(given, key)) is not None:
            if not re.fullmatch("[0-9]+", raw):
                raise ConfigError(f"{key} must be a {'non-negative' if key in _ZERO else 'positive'} integer")
            options[key] = int(raw)
    for key in ("userAgent", *(k for _, k, _ in SWITCHES)):
        if getattr(given, key) is not None:
            options[key] = getattr(given, key)
    config, form = from_options(options), normalize_format(given.format)
    if given.details and form != "console":
        raise ConfigError("--details is only valid with console output")
    return config, form, given.output, given.details, given.trace


def live_crawl(config, stopped):
    from pyspark.sql import SparkSession

    from skein.operators import robots as robots_rules
    from skein.plans.crawl import crawl
    from skein.sources import live

    spark = SparkSession.builder.appName("skein").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    stopped()  # the session set a SIGINT handler of its own: ours comes back
    gap = {"ms": config.min_interval_ms}
    fetch = live.robots_file(config)

    def robots_file(address: str) -> dict:
        got = fetch(address)
        if got["error_kind"] is None and 200 <= (got["status_code"] or 0) < 300:
            rules = robots_rules.parse(got["body"] or "", robots_rules.product_token(config.user_agent))
            if rules.delay is not None and rules.delay * 1000 > config.min_interval_ms:
                gap["ms"] = int(min(robots_rules.DELAY_CAP_MS, rules.delay * 1000))
        return got

    # The gap is known once robots.txt has been read, before the first page is asked for.
    web = lambda urls: live.answers(config, gap["ms"])(urls)
    return crawl(spark, config, web, robots_file, stopped)


def run(argv: list[str], stdout=sys.stdout, stderr=sys.stderr, crawl=live_crawl, write_file=None, exit_now=os._exit) -> int:
    """Files are written first, then stderr, then stdout."""
    try:
        wanted = invocation(argv)
        if wanted is None:
            stdout.write(parser().format_help())
            return 0
    except ConfigError as error:
        stderr.write(f"{error}\n")
        return 2
    from skein.plans import report, trace

    config, form, output, details, with_trace = wanted
    pressed = []

    def on_interrupt(*_):
        pressed.append(1)
        if len(pressed) > 1:
            exit_now(130)

    def stopped() -> bool:
        signal.signal(signal.SIGINT, on_interrupt)
        return bool(pressed)

    before = signal.signal(signal.SIGINT, on_interrupt)
    try:
        result = crawl(config, stopped)
        if len(pressed) > 1:
            return 130
        events = trace.text(result) if with_trace else ""
        if output and output.endswith("/") and form in ("csv", "json"):
            report.save(result, form, output.rstrip("/"))
            out = report.render(result, None, None, False, events)
        else:
            out = report.render(result, form, output, details, events)
        if out["file"]:
            (write_file or _write)(*out["file"])
        stderr.write(out["stderr"])
        stdout.write(out["stdout"])
        return 0
    except Exception as error:
        stderr.write(f"{error}\n")
        return 1
    finally:
        signal.signal(signal.SIGINT, before)


def _write(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
