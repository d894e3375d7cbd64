"""The crawl: generations of set-based steps over a stored web.

Pages are handed out in the order of their creation and committed in that order, so a crawl equals a
breadth-first closure by generations with a total order. A generation is joined to its responses,
redirects are followed hop by hop, and all claims on keys (redirect aliases, declared canonicals,
links) are ordered by (sequence, kind, key); the first claim wins. Where redirects of one
generation contend for a key, outcomes are settled by repeating the step until they stay. Results
are those of one worker; ``concurrency`` changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import http, url, weburl
from skein.operators import robots as robots_rules
from skein.operators import robots_table
from skein.plans.config import CrawlConfig
from skein.shipping import ship
from skein.sources import site
from skein.sources.staging import ranked, running, scratch, staged
from skein.sources.stored import StoredWeb, stored

HOP_LIMIT = 5
PAGES = (
    "canonicalUrl string, requestedUrl string, finalUrl string, discoveredFrom string, depth int, state string, skipReason string, waitedMs bigint, statusCode int, "
    "contentType string, durationMs bigint, byteLength bigint, attempts int, errorKind string, errorMessage string"
)
COLUMNS = [c.split()[0] for c in PAGES.split(", ")]
STATES = ("queued", "fetching", "ok", "skipped", "failed")
#: Of a live web: the answers to a table of URLs, each asked once.
Source = Callable[[DataFrame], DataFrame]
#: The attempts at one URL: what came of each, the wait before the next one (null after the last), and how long it took.
TRIES = "array<struct<status int, kind string, wait bigint, duration bigint>>"
HOP = f"array<struct<key string, url string, status int, type string, attempts int, tries {TRIES}>>"


@dataclass
class CrawlResult:
    config: CrawlConfig
    pages: DataFrame  # COLUMNS, created_ord, sequence
    robots: list[dict]
    stop_reason: str
    started_ms: int
    finished_ms: int
    edges: DataFrame | None = None
    generations: int = 0
    extra: dict = field(default_factory=dict)

    def counts(self) -> DataFrame:
        return counts(self.pages)


def counts(pages: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c).cast("bigint")
    state = F.col("state")
    return pages.agg(
        n(F.col("reserved")).alias("reserved"), n(state == "queued").alias("queued"), n(F.col("attempts") >= 1).alias("fetched"),
        *(n(state == s).alias(s) for s in ("ok", "skipped", "failed")),
    )


def tally(pages: DataFrame, state: str, column: str) -> DataFrame:
    """(name, count) of a reason among the pages of a state, most frequent first, then by name."""
    some = pages.where((F.col("state") == state) & F.col(column).isNotNull())
    return some.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")


def _tries(answers: DataFrame) -> Column:
    """The stored attempts; where a web keeps none, as many as it counts, without waits."""
    plain = F.struct(F.col("status_code").cast("int").alias("status"), F.col("error_kind").alias("kind"), F.lit(None).cast("bigint").alias("wait"), F.lit(0).cast("bigint").alias("duration"))
    made = F.array_repeat(plain, F.coalesce("attempts", F.lit(1)).cast("int")).cast(TRIES)
    return F.coalesce(F.col("tries").cast(TRIES), made) if "tries" in answers.columns else made


def _may(rows: DataFrame, at: str, rules: list | DataFrame) -> DataFrame:
    """Adds whether robots.txt allows a URL: few rules as an expression, many by a join."""
    if isinstance(rules, DataFrame):
        return robots_table.decide(rows, rules, at, "_may")
    return rows.withColumn("_may", robots_rules.allowed(F.col(at), rules))


def _walk(gen: DataFrame, web: StoredWeb | Source, config: CrawlConfig, start_origin: str, rules: list | DataFrame, redirects: bool) -> DataFrame:
    """Follows each row's responses; adds its end and ``hops``, the aliased keys with what was known at each."""
    rows = gen.withColumns({"at": F.col("spelling"), "hops": F.array().cast(HOP), "tried": F.lit(0)})
    done = None
    for hop in range(HOP_LIMIT + 1):
        answers = web(rows.select(F.col("at").alias("url"))).withColumn("n_links", F.size("links")) if callable(web) else web.pages
        got = rows.join(answers.withColumnRenamed("url", "at"), "at", "left")
        got = got.withColumn("tries", _tries(answers))
        got = got.withColumns({"status_code": F.when(F.col("error_kind").isNull(), F.coalesce("status_code", F.lit(404))).otherwise(F.col("status_code")), "tried": F.col("tried") + F.coalesce("attempts", F.lit(1))})
        status = F.col("status_code")
        html = http.is_html(F.col("content_type"))
        redirect = F.col("error_kind").isNull() & status.isin(*http.REDIRECTS)
        if not redirects:  # the web has none: no URL is resolved and one join is enough
            error = F.coalesce("error_kind", F.when(~status.between(200, 299), "http-status"))
            message = F.coalesce("error_message", F.when(F.col("error_kind").isNull() & ~status.between(200, 299), F.concat(F.lit("HTTP "), status)))
            return got.withColumns({"errorKind": error, "errorMessage": message, "skipReason": F.when(error.isNull() & ~html, "non-html")})
        got = url.with_target(got.withColumn("_location", F.when(redirect, F.col("location"))), "_location", "at", "to", "to_key").drop("_location")
        got = _may(got, "to", rules)
        to = F.col("to")
        scheme = F.regexp_extract(to, "^([a-z][a-z0-9+.-]*):", 1)
        named = F.coalesce(to.rlike("^[a-z][a-z0-9+.-]*://[^/?#]*@"), F.lit(False))
        chain = F.concat(F.array("key"), F.transform("hops", lambda h: h["key"]))
        skip = (
            F.when(redirect & to.isNotNull() & ~scheme.isin("http", "https") & ~named, "redirect-off-origin")
            .when(redirect & F.col("to_key").isNotNull() & ~url.origin(to).eqNullSafe(F.lit(start_origin)), "redirect-off-origin")
            .when(~redirect & status.between(200, 299) & ~html, "non-html")
        )
        bad = redirect & (F.col("location").isNull() | (F.col("location") == "") | to.isNull() | named | (scheme.isin("http", "https") & F.col("to_key").isNull()))
        error = (
            F.when(F.col("error_kind").isNotNull(), F.col("error_kind"))
            .when(redirect & F.lit(hop >= HOP_LIMIT), "redirect-limit")
            .when(bad, "bad-redirect")
            .when(redirect & skip.isNull() & F.array_contains(chain, F.col("to_key")), "redirect-loop")
            .when(~redirect & ~status.between(200, 299), "http-status")
        )
        message = (
            F.when(F.col("error_kind").isNotNull(), F.col("error_message"))
            .when(error == "redirect-limit", "redirect hop limit exceeded")
            .when((error == "bad-redirect") & (F.coalesce("location", F.lit("")) == ""), "redirect is missing Location")
            .when((error == "bad-redirect") & to.isNotNull(), "redirect location contains userinfo")
            .when(error == "bad-redirect", "Invalid URL")
            .when(error == "redirect-loop", "redirect loop")
            .when(error == "http-status", F.concat(F.lit("HTTP "), status))
        )
        goes = redirect & error.isNull() & skip.isNull()
        guard = F.when(goes, url.trap_reason(F.col("to_key"), config.max_url_length, config.max_path_depth, config.max_segment_repeats))
        denied = F.when(goes & ~F.coalesce("_may", F.lit(True)), "robots")
        step = F.struct(F.col("to_key").alias("key"), F.col("at").alias("url"), status.cast("int").alias("status"), F.col("content_type").alias("type"), F.col("tried").cast("int").alias("attempts"), F.col("tries").alias("tries"))
        got = got.withColumns({"_goes": goes, "_step": step, "_error": error, "_message": F.when(error.isNotNull(), message), "_skip": F.when(error.isNull(), F.coalesce(skip, guard, denied))})
        got = got.withColumn("hops", F.when(F.col("_goes"), F.concat("hops", F.array("_step"))).otherwise(F.col("hops")))
        got = staged(got, "hop")
        ends = got.where(~(F.col("_goes") & F.col("_skip").isNull())).withColumnsRenamed({"_error": "errorKind", "_message": "errorMessage", "_skip": "skipReason"})
        # A hop that leads nowhere has its tries among the hops already.
        ends = ends.withColumn("tries", F.when(F.col("_goes"), F.array().cast(TRIES)).otherwise(F.col("tries"))).drop("_goes", "_step", "_may", "to", "to_key")
        done = ends if done is None else done.unionByName(ends)
        rows = got.where(F.col("_goes") & F.col("_skip").isNull()).select(*gen.columns, F.col("to").alias("at"), "hops", "tried")
        if rows.isEmpty():
            break
    return done


def _settled(ends: DataFrame, cut: DataFrame | None, hashes: DataFrame | None, config: CrawlConfig, start_origin: str) -> DataFrame:
    """The rows' states, given at which hop a row met a key of an earlier one (cut); hashes: the bodies seen, None to take repeats too."""
    rows = ends.withColumn("met", F.lit(None).cast("int")) if cut is None else ends.join(cut, "sequence", "left")
    met = F.col("met").isNotNull()
    there = F.element_at("hops", F.col("met"))
    rows = rows.withColumns(
        {
            # A URL that gave no answer is not the final one.
            "finalUrl": F.when(met, there["url"]).when(F.col("error_kind").isNotNull() & (F.size("hops") > 0) & ~F.coalesce(F.col("status_code").isNotNull(), F.lit(False)), F.element_at("hops", -1)["url"]).otherwise(F.col("at")),
            "askedUrl": F.when(met, there["url"]).otherwise(F.col("at")),
            "statusCode": F.when(met, there["status"]).otherwise(F.col("status_code").cast("int")),
            "contentType": F.when(met, there["type"]).otherwise(F.col("content_type")),
            "attempts": F.when(met, there["attempts"]).otherwise(F.col("tried").cast("int")),
            "errorKind": F.when(~met, F.col("errorKind")),
            "errorMessage": F.when(~met, F.col("errorMessage")),
            "skipReason": F.when(met, "duplicate").otherwise(F.col("skipReason")),
            "tries": F.when(met, there["tries"]).otherwise(F.col("tries")),
            "trail": F.when(met, F.slice("hops", 1, F.col("met") - 1)).otherwise(F.col("hops")),
        }
    ).withColumn("aliases", F.transform("trail", lambda h: h["key"]))
    fine = F.col("errorKind").isNull() & F.col("skipReason").isNull()
    rows = rows.withColumns({"_sha": F.when(fine, F.col("sha")), "n_links": F.when(fine, F.coalesce("n_links", F.lit(0)))})
    if hashes is not None:
        # Each body's first page, known ones first of all; rows without a body must not meet under one key.
        own = rows.where("_sha IS NOT NULL").select(F.col("_sha").alias("_body"), F.col("sequence").alias("_first"))
        firsts = own.unionByName(hashes.select(F.col("known_sha").alias("_body"), F.lit(-1).cast("bigint").alias("_first"))).groupBy("_body").agg(F.min("_first").alias("_first"))
        rows = rows.withColumn("_body", F.coalesce("_sha", F.concat(F.lit("-"), F.col("sequence").cast("string")))).join(firsts, "_body", "left").drop("_body")
        again = F.col("_sha").isNotNull() & (F.col("_first") != F.col("sequence"))
        rows = rows.withColumn("skipReason", F.when(again, "duplicate-content").otherwise(F.col("skipReason"))).drop("_first")
    fine = F.col("errorKind").isNull() & F.col("skipReason").isNull()
    other = F.col("canonical_key").isNotNull() & (F.col("canonical_key") != F.col("key")) & url.origin(F.col("canonical_url")).eqNullSafe(F.lit(start_origin))
    canonical = fine & other & F.lit(config.respect_canonical)
    return rows.withColumns(
        {
            "to_canonical": canonical, "expands": fine, "new_sha": F.when(fine, F.col("_sha")),
            "skipReason": F.when(canonical, "canonical").otherwise(F.col("skipReason")),
            "state": F.when(F.col("errorKind").isNotNull(), "failed").when(canonical | F.col("skipReason").isNotNull(), "skipped").otherwise("ok"),
            "byteLength": F.when(F.col("statusCode").between(200, 299) & http.is_html(F.col("contentType")) & ~F.col("met").isNotNull(), F.col("byte_length")),
        }
    ).drop("_sha")


def _claims(rows: DataFrame, web: StoredWeb | Source) -> DataFrame:
    """(claimed, sequence, kind, spelling, n, depth, parent): what each row claims; n is the place of a link on its page."""
    base = ["sequence", "depth", F.col("key").alias("parent")]
    none = F.lit(None).cast("string")
    alias = rows.select(*base, F.posexplode("aliases").alias("n", "claimed")).select("sequence", "depth", "parent", "claimed", F.lit(0).alias("kind"), none.alias("spelling"), "n")
    canon = rows.where("to_canonical").select(*base, F.col("canonical_key").alias("claimed"), F.lit(1).alias("kind"), F.col("canonical_url").alias("spelling"), F.lit(0).alias("n"))
    wide = rows.where("expands AND n_links > 0")
    if callable(web):
        links = wide.select(*base, F.posexplode("links").alias("n", "link")).select("sequence", "depth", "parent", "n", "link.url", "link.key")
    else:
        links = wide.select(*base, F.col("at").alias("from_url")).join(web.links, "from_url").select("sequence", "depth", "parent", "n", "url", "key")
    links = links.select("sequence", F.col("depth") + 1, "parent", "key", F.lit(2), "url", "n").toDF("sequence", "depth", "parent", "claimed", "kind", "spelling", "n")
    return alias.unionByName(canon).unionByName(links)


def _first(claims: DataFrame) -> DataFrame:
    """Each key's first claim; of a page that links to a key again, the first spelling."""
    return claims.groupBy("claimed").agg(F.min(F.struct("sequence", "kind", "n", "spelling", "depth", "parent")).alias("c")).select("claimed", "c.*").drop("n")


REFUSED = {"state": "string", "skipReason": "string", "errorKind": "string", "errorMessage": "string", "finalUrl": "string", "askedUrl": "string", "statusCode": "int", "contentType": "string", "attempts": "int", "trail": HOP, "tries": TRIES}


def refused(row: dict, left: int) -> dict:
    """The page in hand when a claim is refused after ``left`` attempts of its own.

    A refused retry leaves what the attempt before it gave; a refused first attempt at a URL leaves
    the page as skipped, with what its redirects gave.
    """
    steps = [(h["url"], h["tries"], h["status"], h["type"]) for h in row["trail"]] + [(row["askedUrl"], row["tries"], None, None)]
    out = dict.fromkeys(REFUSED) | {"state": "skipped", "skipReason": "budget", "attempts": left, "trail": [], "tries": []}
    for n, (at, tries, status, kind) in enumerate(steps):
        if left < len(tries):
            out["trail"] = row["trail"][:n]
            if left:
                end = tries[left - 1]
                out |= {"state": "failed", "skipReason": None, "errorKind": end["kind"] or "http-status", "errorMessage": None if end["kind"] else f"HTTP {end['status']}", "statusCode": end["status"], "contentType": None}
                out |= {"askedUrl": at, "tries": [*tries[: left - 1], end | {"wait": None}], "finalUrl": at if end["kind"] is None or not n else out["finalUrl"]}
            return out
        left -= len(tries)
        out |= {"finalUrl": at, "askedUrl": at, "statusCode": status, "contentType": kind}
    return out


def asked(trail: Column, last: Column, tries: Column) -> Column:
    """What was asked: url, tries and status of each hop, and the last URL, unless the last hop led nowhere (no tries)."""
    hops = F.transform(trail, lambda h: F.struct(h["url"].alias("url"), h["tries"].alias("tries"), h["status"].alias("status")))
    final = F.struct(last.alias("url"), tries.alias("tries"), F.lit(None).cast("int").alias("status"))
    return F.when(F.size(tries) > 0, F.concat(hops, F.array(final))).otherwise(hops)


def _spent(pages: DataFrame, gap: int) -> DataFrame:
    """Adds took, from a page's first attempt to its end, and rest, from there to the next possible start; null without attempts.

    The next attempt starts once the one before has ended, its retry wait is over and the gap since its start has passed.
    """
    every = F.flatten(F.transform(asked(F.coalesce("trail", F.array()), F.col("askedUrl"), F.col("tries")), lambda a: a["tries"]))
    rows = pages.withColumn("_all", F.when((F.col("attempts") > 0) & F.col("tries").isNotNull(), every))
    step = lambda t: F.greatest(t["duration"] + F.coalesce(t["wait"], F.lit(0)), F.lit(gap))
    last = F.element_at("_all", -1)["duration"]
    began = F.aggregate(F.slice("_all", 1, F.size("_all") - 1), F.lit(0).cast("bigint"), lambda s, t: s + step(t))
    return rows.withColumns({"took": F.when(F.col("_all").isNotNull(), began + last), "rest": F.when(F.col("_all").isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.lit(gap) - last))}).drop("_all")


def timed(pages: DataFrame, gap: int, robots_asked: bool) -> DataFrame:
    """Sets waitedMs and durationMs as they are with one worker.

    Attempts follow each other in the crawl's order in steps that add up, so that a page's times need
    only its own attempts and the last one of the page before it.
    """
    # Numbers alone are put in order, once.
    busy = staged(_spent(pages, gap).where("took IS NOT NULL").select("sequence", "took", "rest"), "busy")
    order = staged(running(busy, ["sequence"], {}, "_at"), "starts")
    before = order.select((F.col("_at") + 1).alias("_at"), F.col("rest").alias("_wait"))
    waits = order.select("sequence", "_at", "took").join(before, "_at", "left").select("sequence", "took", F.coalesce("_wait", F.lit(gap if robots_asked else 0)).cast("bigint").alias("waited"))
    return pages.join(waits, "sequence", "left").withColumns({"waitedMs": F.col("waited"), "durationMs": F.col("took")}).select(pages.columns)


def _meets(ends: DataFrame, seen: DataFrame, first: DataFrame | None) -> DataFrame:
    """(sequence, met): a row's first hop whose key another row owns already."""
    hops = ends.select("sequence", "key", F.posexplode("hops").alias("n", "hop")).select("sequence", "key", "n", F.col("hop.key").alias("claimed"))
    old = hops.join(seen, "claimed").where(F.col("owner") != F.col("sequence"))
    met = old.select("sequence", "n")
    if first is not None:
        met = met.unionByName(hops.join(first.select("claimed", F.col("sequence").alias("by")), "claimed").where("by < sequence").select("sequence", "n"))
    return met.groupBy("sequence").agg((F.min("n") + 1).cast("int").alias("met"))


def crawl(
    spark: SparkSession, config: CrawlConfig, web: DataFrame | StoredWeb | Source, robots_web: DataFrame | dict | Callable | None = None,
    stopped: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.time,
) -> CrawlResult:
    """Crawls a stored web: url, status_code, content_type, location, error_kind, error_message, attempts, tries, byte_length, sha, links (url, key), canonical_url, canonical_key.

    URLs that aren't stored answer 404. A live web is a function from URLs to such rows. robots_web:
    scripted responses of robots.txt files, what they give by URL, or a function that gets one. stopped: asked before each
    generation; once it says so, what waits stays queued and the crawl was interrupted. clock gives
    the time in seconds.
    """
    ship(spark)
    started = int(clock() * 1000)
    with scratch() as keep:
        own = web if callable(web) else stored(web)
        try:
            return _crawl(spark, config, own, robots_web, stopped, clock, started, keep)
        finally:
            if not callable(own):
                own.drop()


#: Parts of what has been seen that are read side by side, before they are written as one.
SEEN_PARTS = 16


def _crawl(spark, config, web, robots_web, stopped, clock, started, keep) -> CrawlResult:
    start = str(weburl.parse(config.start_url))
    start_key, start_origin = weburl.canonical_key(start), weburl.parse(start).origin
    if isinstance(robots_web, DataFrame):
        robots_web = site.robots_files(robots_web, config.retry_count, config.retry_base_delay_ms)
    robots = robots_rules.load(start_origin, robots_rules.product_token(config.user_agent), config.respect_robots, robots_web if callable(robots_web) else (robots_web or {}).get)
    redirects = callable(web) or not web.pages.where(F.col("status_code").isin(*http.REDIRECTS)).isEmpty()
    queued = spark.createDataFrame([(0, start_key, start, None, 0)], "created_ord bigint, key string, spelling string, discovered_from string, depth int")
    queued = queued.withColumns({"sequence": F.col("created_ord"), "parent_sequence": F.lit(-1).cast("bigint")})
    seen = [spark.createDataFrame([(start_key, 0)], "claimed string, owner bigint")]
    hashes = [spark.createDataFrame([], "known_sha string")]
    created, sequence, reserved, waiting, stop, spent = 1, 1, 1, 1, "completed", robots.attempts
    pages, generations = [], 0
    gap = config.min_interval_ms if robots.outcome != "parsed" or robots.rules.delay is None else max(config.min_interval_ms, min(robots_rules.DELAY_CAP_MS, int(robots.rules.delay * 1000)))
    elapsed = gap if robots.attempts else 0
    shape = [*COLUMNS, "created_ord", "sequence", "reserved", "parent_sequence", "trail", "n_links", "tries", "askedUrl"]

    def page(df: DataFrame, **values: Column) -> DataFrame:
        kinds = dict(x.split() for x in PAGES.split(", ")) | {"created_ord": "bigint", "sequence": "bigint", "reserved": "boolean", "parent_sequence": "bigint", "trail": HOP, "n_links": "bigint", "tries": TRIES, "askedUrl": "string"}
        own = {"canonicalUrl": F.col("key"), "requestedUrl": F.col("spelling"), "discoveredFrom": F.col("discovered_from"), "attempts": F.lit(0)} | values
        return df.select(*((own.get(c) if c in own else F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in shape))

    def whole(parts: list[DataFrame], name: str) -> DataFrame:
        """The union of what each generation has added; many parts become one."""
        if len(parts) > SEEN_PARTS:
            parts[:] = [staged(reduce(DataFrame.unionByName, parts), name)]
        return reduce(DataFrame.unionByName, parts)

    rules, ruled = robots.rules.rules, bool(robots.rules.rules)
    if len(rules) > robots_rules.BRANCHES:
        rules = robots_table.prepared(spark.createDataFrame([(start_origin, *x) for x in rules], "origin string, allow boolean, pattern string"))
    while waiting:
        # A live crawl's time is the clock's, a stored one's that of its schedule.
        late = callable(web) and config.max_duration_ms is not None and clock() * 1000 - started >= config.max_duration_ms
        if late or stopped():
            stop = "budget" if late else "interrupted"
            pages.append(page(queued, state=F.lit("queued"), reserved=F.lit(True), sequence=F.lit(None)))
            break
        generations += 1
        if robots.outcome == "unavailable":
            pages.append(page(queued, state=F.lit("skipped"), skipReason=F.lit("robots-unavailable"), reserved=F.lit(True)))
            break
        asking = staged(_may(queued, "spelling", rules), "asking") if ruled else None
        ends = staged(_walk(asking.where("_may").drop("_may") if ruled else queued, web, config, start_origin, rules, redirects), "ends")
        denied = asking.where("NOT _may").drop("_may") if ruled else None
        known = whole(seen, "seen")
        bodies = whole(hashes, "hashes") if config.dedupe_content else None
        hopping = redirects and not ends.where(F.size("hops") > 0).isEmpty()
        cut = staged(_meets(ends, known, None), "met") if hopping else None
        before = None
        while True:
            rows = staged(_settled(ends, cut, bodies, config, start_origin), "settled")
            first = _first(_claims(rows, web))
            if not hopping:
                break
            first = staged(first, "first")
            cut = staged(_meets(ends, known, first), "met")
            now = cut.agg(F.count("*"), F.bit_xor(F.xxhash64("sequence", "met"))).first()
            if now == before:
                break
            before = now
        beyond = None
        if config.max_duration_ms is not None and not callable(web):
            busy = _spent(rows, gap).where("took IS NOT NULL").select("sequence", "took", "rest")
            placed = staged(running(busy, ["sequence"], {"before": F.col("took") + F.col("rest")}, "n"), "schedule")
            # The page in hand when the time is over is finished; what comes after it is not taken.
            beyond = placed.where(F.col("before") + F.col("took") + elapsed >= config.max_duration_ms).agg(F.min("sequence")).first()[0]
            elapsed += placed.agg(F.coalesce(F.sum(F.col("took") + F.col("rest")), F.lit(0))).first()[0]
            if beyond is not None:
                rows = rows.where(F.col("sequence") <= beyond)
        if config.max_total_attempts is not None:
            # With one worker attempts are claimed in the pages' order; the first claim that is refused ends the crawl.
            placed = ranked(rows.select("sequence", "attempts"), ["sequence"], "n", F.col("attempts"), "before")
            cut_at = placed.where(F.col("before") + F.col("attempts") + spent > config.max_total_attempts).agg(F.min(F.struct("sequence", "before"))).first()[0]
            if cut_at is not None:
                beyond = cut_at["sequence"]
                own = refused(rows.where(F.col("sequence") == beyond).first().asDict(recursive=True), config.max_total_attempts - spent - cut_at["before"])
                own_page = spark.createDataFrame([(beyond, *own.values())], "sequence bigint, " + ", ".join(f"{k} {REFUSED[k]}" for k in own))
                pages.append(page(queued.join(own_page, "sequence"), attempts=F.col("attempts"), reserved=F.lit(True)))
                rows = rows.where(F.col("sequence") < beyond)
            else:
                spent += rows.agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0]
        if beyond is not None:
            stop = "budget"
            pages.append(page(queued.where(F.col("sequence") > beyond), state=F.lit("queued"), reserved=F.lit(True), sequence=F.lit(None)))
            denied = None if denied is None else denied.where(F.col("sequence") < beyond)
            first = _first(_claims(rows, web))
        if denied is not None:
            pages.append(page(denied, state=F.lit("skipped"), skipReason=F.lit("robots"), reserved=F.lit(True)))
        pages.append(page(rows, attempts=F.col("attempts"), reserved=F.lit(True)))
        fresh = first.where("kind > 0").join(known, "claimed", "left_anti")
        inside = F.when(F.col("spelling").startswith(f"{start_origin}/"), True).otherwise(url.origin(F.col("spelling")).eqNullSafe(F.lit(start_origin)))
        trap = url.trap_reason(F.col("claimed"), config.max_url_length, config.max_path_depth, config.max_segment_repeats)
        fresh = fresh.withColumn("reason", F.when(~inside, "other-origin").when(F.col("depth") > config.max_depth, "depth-limit").otherwise(trap))
        # Written, as a range partition reads its input twice.
        fresh = staged(fresh, "fresh")
        # Those that are let in stand at the front of those that may be, so their number before is their place too.
        placed = running(fresh, ["sequence", "kind", "claimed"], {"before": F.col("reason").isNull().cast("bigint")}, "n")
        full = F.col("reason").isNull() & (F.col("before") + reserved >= config.max_pages)
        placed = placed.withColumn("skipReason", F.when(full, "page-limit").otherwise(F.col("reason"))).withColumn("created_ord", F.col("n") + created)
        placed = placed.withColumnsRenamed({"claimed": "key", "parent": "discovered_from", "sequence": "parent_sequence"})
        placed = staged(placed.withColumn("sequence", F.when(F.col("skipReason").isNull(), F.col("before") + sequence)).drop("n", "before", "reason"), "placed")
        n, waiting = placed.agg(F.count("*"), F.count("sequence")).first()
        pages.append(page(placed.where("skipReason IS NOT NULL"), state=F.lit("skipped"), skipReason=F.col("skipReason"), reserved=F.lit(False), sequence=F.lit(None)))
        queued = placed.where("sequence IS NOT NULL").select("created_ord", "key", "spelling", "discovered_from", "depth", "sequence", "parent_sequence")
        seen.append(placed.select(F.col("key").alias("claimed"), F.coalesce("sequence", F.lit(-1)).alias("owner")))
        if hopping:
            seen.append(rows.select(F.explode("aliases").alias("claimed"), F.col("sequence").alias("owner")))
        hashes.append(rows.where("new_sha IS NOT NULL").select(F.col("new_sha").alias("known_sha")))
        created, sequence, reserved = created + n, sequence + waiting, reserved + waiting
        if stop == "budget":
            # What the pages before the refusal led to has been let in and waits.
            pages.append(page(queued, state=F.lit("queued"), reserved=F.lit(True), sequence=F.lit(None)))
            break
    summary = [{"origin": start_origin, "statusCode": robots.status, "outcome": robots.outcome, "errorKind": robots.error}]
    result = keep(timed(reduce(DataFrame.unionByName, pages), gap, robots.attempts > 0), "pages")
    edges = result.where("discoveredFrom IS NOT NULL").select("discoveredFrom", "canonicalUrl", "depth")
    return CrawlResult(config, result, summary, stop, started, int(clock() * 1000), edges, generations, {"robots_attempts": robots.attempts})
