"""robots.txt of many origins as tables: redirects followed by joins, rules as rows, the longest match by an equi-join.

``records`` follows all origins' redirects at once, a join for each hop. ``rules`` reads the files on the
executors. ``decide`` joins URLs to the rules of their origins: a rule is known by its literal lead
(what stands before its first wildcard), a URL by its path's prefixes of the lengths that its origin's
rules have, so that rules are found by an equi-join, whatever their number; wildcards are verified
afterwards. Nothing of these tables comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import http, url
from skein.operators.robots import DELAY_CAP_MS, HOPS, ROBOTS_BYTES, parse
from skein.sources.staging import scratch, staged


def _redirect() -> Column:
    return F.coalesce(F.col("status_code").isin(*http.REDIRECTS), F.lit(False))


def newest(answers: DataFrame, at: str = "answered") -> DataFrame:
    """Of each URL, the answer given last (ties: any total order of the answers' columns, so reruns agree)."""
    rest = [c for c in answers.columns if c not in ("url", at)]
    last = F.max(F.struct(F.col(at), *rest))
    return answers.groupBy("url").agg(last.alias("last")).select("url", *(F.col("last")[c].alias(c) for c in rest))


def records(origins: DataFrame, answers: DataFrame) -> DataFrame:
    """What each origin's robots.txt comes to: origin, status_code, outcome, error_kind, body (if parsed), attempts, hops; staged.

    origins: a column origin, each once. answers: url, status_code, location, error_kind, body and attempts
    of what asking a URL ends in, one row a URL; URLs that aren't there answer 404. A redirect may leave
    the host. One to a URL that was asked before is a loop, the sixth one is over the limit, and one
    without a target, with userinfo or to another scheme is bad.
    """
    with scratch() as keep:
        # Where each redirect leads is resolved once, not hop by hop.
        asked = answers.select("url", "status_code", F.when(_redirect() & (F.col("location") != ""), F.col("location")).alias("location"), "error_kind", "body", "attempts")
        answers = url.with_resolved(asked, "location", "url", "to").drop("location")
        answers = answers.select(*(F.col(c).alias(f"_{c}") for c in answers.columns))
        first = F.concat("origin", F.lit("/robots.txt"))
        rows = origins.select("origin", first.alias("at"), F.array().cast("array<string>").alias("chain"), F.lit(0).cast("bigint").alias("attempts"))
        ends = None
        for hop in range(HOPS + 1):
            got = rows.join(answers, F.col("at") == F.col("_url"), "left")
            got = got.select(
                "origin", F.concat("chain", F.array("at")).alias("chain"), (F.col("attempts") + F.coalesce("_attempts", F.lit(1))).alias("attempts"), F.col("_to").alias("to"), F.col("_error_kind").alias("error_kind"),
                F.when(F.col("_error_kind").isNull(), F.coalesce("_status_code", F.lit(404))).cast("int").alias("status_code"), F.col("_body").alias("body"),
            )
            got = staged(got, "robots_hop")
            ends = _ended(got, hop) if ends is None else ends.unionByName(_ended(got, hop))
            if hop < HOPS:
                going = got.where(_redirect() & _good(F.col("to")) & ~F.array_contains("chain", F.col("to")))
                rows = going.select("origin", F.col("to").alias("at"), "chain", "attempts")
                if rows.isEmpty():
                    break
        return keep(ends, "robots_records")


def _good(to: Column) -> Column:
    return F.coalesce(to.rlike("^https?:") & ~to.rlike("^[^/]*//[^/?#]*@"), F.lit(False))


def _ended(got: DataFrame, hop: int) -> DataFrame:
    status, to = F.col("status_code"), F.col("to")
    redirect = _redirect()
    fine, large = status.between(200, 299), F.octet_length("body") > ROBOTS_BYTES
    kind = (
        F.when(F.col("error_kind").isNotNull(), F.col("error_kind"))
        .when(redirect & F.lit(hop >= HOPS), "redirect-limit")
        .when(redirect & ~_good(to), "bad-redirect")
        .when(redirect & F.array_contains("chain", to), "redirect-loop")
        .when(fine & F.coalesce(large, F.lit(False)), "too-large")
        .when(~redirect & ~fine & ~(status.between(400, 499) & (status != 429)), "http-status")
    )
    ended = got.withColumn("kind", kind).where(~redirect | F.col("kind").isNotNull())
    outcome = F.when(F.col("kind").isNotNull(), "unavailable").when(fine, "parsed").otherwise("allow-all")
    known = F.col("kind").isNull() | (F.col("kind") == "http-status")
    return ended.select(
        "origin", F.when(known, status).alias("status_code"), outcome.alias("outcome"), F.col("kind").alias("error_kind"),
        F.when(F.col("kind").isNull() & fine, F.coalesce("body", F.lit(""))).alias("body"), "attempts", F.lit(hop).alias("hops"),
    )


RULES = "origin string, allow boolean, pattern string, delay double"


def rules(files: DataFrame, token: str) -> DataFrame:
    """The rules that hold for a product token, read from parsed records: origin, allow, pattern; and a row with a null pattern for a crawl delay; staged."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for origin, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = parse(body, token)
                out += [(origin, allow, pattern, None) for allow, pattern in own.rules]
                if own.delay is not None:
                    out.append((origin, None, None, own.delay))
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["origin", "allow", "pattern", "delay"])

    return staged(files.where("outcome = 'parsed'").select("origin", "body").mapInArrow(read, RULES), "robots_rules")


def gaps(records: DataFrame, rules: DataFrame, min_interval: int) -> DataFrame:
    """origin and gap_ms: the crawl delay that a parsed file asks for, at most ten seconds, if that is longer than the interval."""
    asked = rules.where("pattern IS NULL").groupBy("origin").agg(F.max("delay").alias("delay"))
    rows = records.select("origin").join(asked, "origin", "left")
    ms = F.col("delay") * 1000
    return rows.select("origin", F.when(ms > min_interval, F.least(F.lit(float(DELAY_CAP_MS)), ms)).otherwise(F.lit(float(min_interval))).cast("bigint").alias("gap_ms"))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules as ``decide`` joins them: origin, lead, wild, n, allow, and for wildcards the expression that verifies them; staged.

    Equal patterns become one, which allows if one of them does. Rules without wildcards are their own lead.
    """
    own = rules.where("pattern IS NOT NULL").groupBy("origin", "pattern").agg(F.max("allow").alias("allow"))
    p = F.col("pattern")
    end = p.endswith("$")
    body = F.when(end, F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    lead = F.substring_index(body, "*", 1)
    rest = F.substr(body, F.length(lead) + F.lit(1), F.length(body))
    literal = lambda s: F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.transform(F.split(rest, "\\*"), literal)
    verify = F.concat(F.lit("(?s)^"), F.array_join(pieces, ".*"), F.when(end, "\\z").otherwise(""))
    wild = end | (F.instr(p, "*") > 0)
    return staged(own.select("origin", lead.alias("lead"), wild.alias("wild"), F.length(p).alias("n"), "allow", F.when(wild, verify).alias("verify")), "robots_leads")


def path_of(at: Column) -> Column:
    """Path and query of a URL, which rules are matched against."""
    place = F.regexp_extract(at, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place))


def decide(rows: DataFrame, rules: DataFrame, at: str, name: str = "allowed") -> DataFrame:
    """Adds whether the rules of its origin (as ``prepared``) allow each URL: the longest one that matches, allow in a tie, yes without one; staged.

    Each row is worked on by itself, so repeated ones and any columns may be there. URLs without an
    origin have no rules.
    """
    with scratch() as keep:
        numbered = staged(rows.withColumns({"__row": F.monotonically_increasing_id(), "__origin": url.origin(F.col(at)), "__path": path_of(F.col(at))}), "asked")
        # The lengths in use are few: as many as a pattern has characters, at most.
        lengths = staged(rules.groupBy("origin").agg(F.collect_set(F.length("lead")).alias("lengths")), "lengths")
        places = numbered.select("__row", "__origin", "__path").join(lengths, F.col("__origin") == F.col("origin")).drop("origin")
        fitting = F.filter("lengths", lambda k: k <= F.length("__path"))
        prefixes = staged(places.select("__row", "__origin", "__path", F.explode(fitting).alias("k")).withColumn("__lead", F.substr("__path", F.lit(1), F.col("k"))), "prefixes")
        # Both sides are plain scans: the planner can split the partition of a prefix that very many URLs have.
        met = prefixes.join(rules, (F.col("__origin") == F.col("origin")) & (F.col("__lead") == F.col("lead")))
        rest = F.substr("__path", F.col("k") + F.lit(1), F.length("__path"))
        met = met.where(~F.col("wild") | F.rlike(rest, F.col("verify")))
        best = staged(met.groupBy("__row").agg(F.max(F.struct("n", "allow")).alias("best")), "longest")
        out = numbered.join(best, "__row", "left").withColumn(name, F.coalesce(F.col("best")["allow"], F.lit(True)))
        return keep(out.select(*(F.col(f"`{c}`") for c in rows.columns), name), "decided")
