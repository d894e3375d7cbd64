"""The trace of a crawl: one row an event, in the order of a crawl with one worker.

It is derived from the pages: each one says when it was taken, which redirects it followed and after
how many attempts and waits, how many links it has, and which page created it.
"""

from __future__ import annotations

from collections.abc import Callable
from logging import getLogger

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import http, weburl
from skein.plans.crawl import CrawlResult, asked

#: Fields in an order that is that of every event's own.
FIELDS = {"from": "string", "to": "string", "status": "int", "url": "string", "depth": "int", "allowed": "boolean", "attempt": "int", "discovered": "bigint",
          "sequence": "bigint", "state": "string", "reason": "string", "next": "int", "wait": "bigint", "last_status": "int", "kind": "string"}
#: Fields that a line names otherwise, as they stand elsewhere in it.
LABELS = {"last_status": "status"}
STOPPED = {"completed": "completed", "budget": "budget", "interrupted": "interrupted"}


def _event(name: str, place: tuple, **fields: Column) -> Column:
    """place: page in hand, step, hop, kind within a hop, number."""
    at = [(F.lit(p) if isinstance(p, int) else p).cast("bigint") for p in (*place, 0, 0, 0, 0)[:5]]
    rest = [fields.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()]
    return F.struct(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(at))).alias("place"), F.lit(name).alias("event"), *rest)


def _when(condition: Column, event: Column) -> Column:
    return F.filter(F.array(F.when(condition, event)), lambda e: e.isNotNull())


def events(result: CrawlResult) -> DataFrame:
    """place, event, and the fields of FIELDS that the event has; sort by place."""
    spark = result.pages.sparkSession
    checked = result.robots[0]["outcome"] if result.robots else "not-checked"
    url, s = F.col("requestedUrl"), F.col("sequence")
    skip, taken = F.col("skipReason"), F.col("sequence").isNotNull()
    trail = F.coalesce("trail", F.array())
    n = F.size(trail)
    denied = skip.isin("robots", "robots-unavailable") & (F.col("attempts") == 0)
    created = F.when(F.col("reserved"), _event("reserved", (F.col("parent_sequence"), 4, F.col("created_ord")), url=url, depth=F.col("depth"), reason=F.when(F.col("discoveredFrom").isNull(), "start").otherwise("discovered"))).otherwise(
        _event("skipped", (F.col("parent_sequence"), 4, F.col("created_ord")), url=url, reason=skip)
    )

    def at_hop(h: Column, i: Column) -> Column:
        def attempt(t: Column, k: Column) -> Column:
            retry = _event("retry", (s, 2, i, 0, 2 * k + 1), url=h["url"], next=k + 2, wait=t["wait"], last_status=F.when(t["kind"].isNull(), t["status"]), kind=t["kind"])
            return F.concat(F.array(_event("attempt-start", (s, 2, i, 0, 2 * k), url=h["url"], attempt=k + 1)), _when(t["wait"].isNotNull(), retry))

        to = F.get(F.col("_asked"), i + 1)["url"]
        onward = (_event("robots-check", (s, 2, i, 1), url=to, allowed=F.lit(True)), _event("redirect", (s, 2, i, 2), **{"from": h["url"], "to": to, "status": h["status"]}))
        return F.concat(F.flatten(F.transform(h["tries"], attempt)), F.filter(F.array(*onward), lambda _: to.isNotNull()))

    pages = result.pages.withColumn("_asked", F.when((F.col("attempts") > 0) & F.col("tries").isNotNull(), asked(trail, F.coalesce("askedUrl", url), F.col("tries"))).otherwise(F.array()))
    hop_denied = (skip == "robots") & (F.col("attempts") > 0) & (n > 0)
    own = F.concat(
        F.array(created),
        _when(taken, _event("take", (s, 0), url=url, depth=F.col("depth"), sequence=s)),
        _when(taken, _event("robots-check", (s, 1, 1), url=url, allowed=~denied, reason=F.when(denied, skip))),
        F.flatten(F.transform("_asked", at_hop)),
        _when(hop_denied, _event("robots-check", (s, 2, n, 3), url=F.element_at(trail, -1)["key"], allowed=F.lit(False), reason=skip)),
        _when(F.col("n_links").isNotNull(), _event("links", (s, 3), url=F.col("finalUrl"), discovered=F.col("n_links"))),
        _when(taken, _event("commit", (s, 5), sequence=s, state=F.col("state"))),
    )
    rows = pages.select(F.explode(own).alias("e")).select("e.*")
    robots_url = F.lit(f"{weburl.parse(result.config.start_url).origin}/robots.txt")
    ends = [_event("crawl-start", (-2,), url=F.lit(result.config.start_url)), _event("crawl-stop", (1 << 62,), reason=F.lit(STOPPED[result.stop_reason]))]
    if checked != "not-checked":
        ends += [_event("attempt-start", (0, 1, 0, 0, k), url=robots_url, attempt=F.lit(k)) for k in range(1, result.extra.get("robots_attempts", 0) + 1)]
    return rows.unionByName(spark.range(1).select(F.explode(F.array(*ends)).alias("e")).select("e.*"))


def lines(result: CrawlResult) -> DataFrame:
    """place and line; a null field is left out."""
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{LABELS.get(f, f)}="), http.trace_value(F.col(f)))) for f in FIELDS]
    return events(result).select("place", F.concat_ws(" ", F.concat(F.lit("[trace] "), F.col("event")), *parts).alias("line"))


def text(result: CrawlResult) -> str:
    return "".join(f"{r['line']}\n" for r in lines(result).orderBy("place").toLocalIterator())


def emit(result: CrawlResult, sink: Callable[[str], None]) -> None:
    """Hands each line to a sink. One that fails is reported once and gets no more; the crawl is not touched."""
    for row in lines(result).orderBy("place").toLocalIterator():
        try:
            sink(row["line"])
        except Exception as error:
            getLogger("skein").error("trace sink failed: %s", error)
            return
