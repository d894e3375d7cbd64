"""URL identity, traps and display as Column expressions.

URLs of plain shape stay in the JVM; ``exact_key`` and ``resolve`` (Arrow UDFs over
``skein.functions.weburl``) cover odd characters and hosts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.staging import staged

SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#:@]*)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SHAPE, group)


def _default_port(scheme: Column, port: Column) -> Column:
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(plain, "").otherwise(F.concat(F.lit(":"), port))


def origin(url: Column) -> Column:
    """scheme://host[:port]; null if the URL isn't http(s) or has userinfo."""
    scheme = F.lower(_part(url, 1))
    out = F.concat(scheme, F.lit("://"), F.lower(_part(url, 2)), _default_port(scheme, _part(url, 3)))
    return F.when(url.rlike(SHAPE) & scheme.isin("http", "https") & (_part(url, 2) != ""), out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def path(url: Column) -> Column:
    return bound(_part(url, 4), lambda p: F.when(p == "", "/").otherwise(p))


def query_pairs(url: Column) -> Column:
    """Decoded (name, value) pairs, sorted by both; empty parts vanish, a name alone has an empty value."""
    parts = F.filter(F.split(_part(url, 5), "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + F.lit(1), F.length(p))).otherwise("")
        decoded = (F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" "))) for x in (name, value))
        return F.struct(*(d.alias(n) for d, n in zip(decoded, ("name", "value"))))

    return F.array_sort(F.transform(parts, pair))


def query_string(url: Column) -> Column:
    pairs = F.transform(query_pairs(url), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])))
    return F.array_join(pairs, "&")


def plain(url: Column) -> Column:
    """Whether the expressions give the key: plain ASCII hosts, no dot segments, only escapes of ASCII in the query.

    Each test is one pass over characters: a pattern that repeats a group would recurse once a character.
    """
    own = F.substring_index(url, "#", 1)
    host = F.lower(F.regexp_extract(own, "^[A-Za-z]+://([^/?:]*)", 1))
    odd = (
        own.rlike("[^A-Za-z0-9_~!$&'()*+,;=:@%./?-]") | own.rlike("(?i)^[^?]*/(?:[.]|%2e)") | own.rlike(r"^[^?]*\?.*%(?![0-7][0-9A-Fa-f])")
        | host.rlike("[^a-z0-9.-]") | host.rlike(r"^\.|\.\.|\.$") | host.rlike(r"(?:^|\.)(?:[0-9]*$|0x[0-9a-f]*$|xn--)")
    )
    shape = own.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?:]+(?::(?:[1-9]\d{0,3}|[1-5]\d{4})?)?(?:[/?]|$)")
    return F.coalesce(shape & ~odd, F.lit(False))


def plain_key(url: Column) -> Column:
    """The identity of a plain URL: origin, path without closing slashes, sorted query."""
    bare = F.rtrim(path(url), F.lit("/"))
    text = query_string(url)
    return F.concat(origin(url), F.when(bare == "", "/").otherwise(bare), F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))


def canonical_key(url: Column) -> Column:
    """The identity of a URL as one expression; null if there is none. Over tables, ``with_key`` keeps plain rows out of the exact function."""
    own = plain(url)
    return F.when(own, plain_key(url)).otherwise(exact_key(F.when(~own, url)))


def split(rows: DataFrame, plain: Column, fast: Callable, exact: Callable) -> DataFrame:
    """fast(rows that are plain) and exact(the others): where there are no others, the plan has no Python."""
    own = F.coalesce(plain, F.lit(False))
    some, odd = fast(rows.where(own)), rows.where(~own)
    return some if odd.isEmpty() else some.unionByName(exact(odd))


def _told_apart(rows: DataFrame, plain: Column, known: dict[str, Column], exact: Callable) -> DataFrame:
    """Rows with the columns of known: these where plain, else from exact. All is worked out once and written, so that neither branch does it again."""
    columns = [c for c in rows.columns if c not in known]
    at = staged(rows.select("*", F.coalesce(plain, F.lit(False)).alias("__plain"), *(v.alias(f"__known_{k}") for k, v in known.items())), next(iter(known)))
    return split(at, F.col("__plain"), lambda r: r.select(*columns, *(F.col(f"__known_{k}").alias(k) for k in known)), lambda r: exact(r).select(*columns, *known))


def with_key(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Adds the identity of a URL; staged."""
    at = F.col(url)
    return _told_apart(rows, at.isNull() | plain(at), {name: F.when(at.isNotNull(), plain_key(at))}, lambda r: r.withColumn(name, exact_key(at)))


def requested_spelling(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def path_segments(url: Column) -> Column:
    # A path has no more segments than characters.
    return bound(path(url), lambda p: F.when(p == "/", F.array().cast("array<string>")).otherwise(F.slice(F.split(p, "/"), 2, F.length(p) + 1)))


def trap_reason(key: Column, max_url_length: int = 2048, max_path_depth: int = 16, max_segment_repeats: int = 2) -> Column:
    def repeats(named: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(named), lambda s: F.size(F.filter(named, lambda x: x == s))))

    def reason(segments: Column) -> Column:
        most = bound(F.filter(segments, lambda s: s != ""), repeats)
        return F.when(F.size(segments) > max_path_depth, "path-depth").when(F.coalesce(most, F.lit(0)) > max_segment_repeats, "repeated-segment")

    return F.when(F.length(key) > max_url_length, "url-length").otherwise(bound(path_segments(key), reason))


def link_problem(url: Column) -> Column:
    """Why a resolved link is no candidate: unparsable, scheme or userinfo; null if it is one."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (
        F.when(url.isNull() | (scheme == ""), "unparsable")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(url.rlike("^[^/]*//[^/?#]*@"), "userinfo")
        .when(origin(url).isNull(), "unparsable")
    )


#: Fixed values of the URL standard: schemes with a host, and what their paths and queries percent-encode beside controls and non-ASCII.
SPECIAL = "http|https|ftp|wss?"
_PATH_UNSAFE, _QUERY_UNSAFE = r"\x20\"#<>?`{}^", r"\x20\"#<>'"


def _encoded(text: Column, unsafe: str) -> Column:
    odd = rf"[^\x20-\x7E]|[{unsafe}]"
    each = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    whole = F.array_join(F.transform(each, lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)), "")
    return F.when(text.rlike(odd), whole).otherwise(text)


#: A segment of one or two dots, escaped or not.
_DOTS = r"(?i)^(?:[.]|%2e){1,2}$"


def _without_dots(path: Column) -> Column:
    """A path, with its first slash, without dot segments: a stack of segments, from which two dots take the last."""
    parts = F.split(path, "/")
    own = F.slice(parts, 2, F.size(parts) - 1)
    dots = lambda s: s.rlike(_DOTS)
    two = lambda s: F.length(F.regexp_replace(s, "(?i)%2e", ".")) == 2

    def step(out: Column, segment: Column) -> Column:
        popped = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(~dots(segment), F.concat(out, F.array(segment))).when(two(segment), popped).otherwise(out)

    folded = F.aggregate(own, F.array().cast("array<string>"), step)
    last = F.when(dots(F.element_at(own, -1)), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.rlike(r"(?i)/(?:[.]|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(last, "/"))).otherwise(path)


def _reference(text: Column) -> dict[str, Column]:
    """The parts of a reference without outer white space and fragment."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+\z", "")
    return {"ref": F.substring_index(F.regexp_replace(bare, r"[\t\n\r]", ""), "#", 1)}


def with_resolved(rows: DataFrame, raw: str, base: str, name: str) -> DataFrame:
    """Adds a reference against its base, as the URL standard resolves it, without its fragment; null if it is no URL.

    Dot segments, escapes and all forms of references are expressions; hosts that aren't plain ASCII
    names, and bases that aren't http(s), go to the exact function. Staged.
    """
    out = _told_apart(_resolution(rows, raw, base), F.col("__fine"), {name: F.col("__url")}, lambda r: r.withColumn(name, resolve(F.col(raw), F.col(base))))
    return out.drop("__fine", "__url")


def with_target(rows: DataFrame, raw: str, base: str, name: str, key: str) -> DataFrame:
    """Adds a reference against its base, as with_resolved does, and the identity of what it leads to; staged once."""
    told, to = _resolution(rows, raw, base), F.col("__url")
    known = {name: F.when(F.col(raw).isNotNull(), to), key: F.when(F.col(raw).isNotNull() & to.isNotNull(), plain_key(to))}
    fine = F.col(raw).isNull() | (F.col("__fine") & (to.isNull() | plain(to)))
    out = _told_apart(told, fine, known, lambda r: r.withColumn(name, resolve(F.col(raw), F.col(base))).withColumn(key, exact_key(F.col(name))))
    return out.drop("__fine", "__url")


def _resolution(rows: DataFrame, raw: str, base: str) -> DataFrame:
    """Adds __url, a reference against its base, and __fine, whether the expressions can tell it."""
    columns, c = rows.columns, lambda k: F.col(f"__r_{k}")
    part = lambda pattern, k, n=1: F.regexp_extract(c(k), pattern, n)
    shape = rf"(?is)^((?:{SPECIAL})):(.*)$"

    def parts(step: DataFrame, values: dict[str, Column]) -> DataFrame:
        return step.withColumns({f"__r_{k}": v for k, v in values.items()})

    step = rows
    for side, column in (("b", base), ("r", raw)):
        step = parts(step, {f"{side}_text": _reference(F.col(column))["ref"]})
        special = c(f"{side}_text").rlike(shape)
        step = parts(step, {
            f"{side}_special": special, f"{side}_scheme": F.lower(part(r"^([A-Za-z][A-Za-z0-9+.\-]*):", f"{side}_text")),
            f"{side}_rest": F.when(special, part(shape, f"{side}_text", 2)).otherwise(c(f"{side}_text")),
        })
        step = parts(step, {
            f"{side}_body": F.translate(part(r"(?s)^([^?]*)", f"{side}_rest"), "\\", "/"),
            f"{side}_query": F.when(F.instr(c(f"{side}_rest"), "?") > 0, F.concat(F.lit("?"), _encoded(part(r"(?s)^[^?]*\?(.*)$", f"{side}_rest"), _QUERY_UNSAFE))).otherwise(""),
        })
    # A special scheme that is the base's, without two slashes, stands for none.
    slashes = c("r_body").startswith("//")
    foreign = (c("r_scheme") != "") & ~c("r_special")
    relative = ~slashes & ((c("r_scheme") == "") | (c("r_special") & (c("r_scheme") == c("b_scheme"))))
    step = parts(step, {"relative": relative, "foreign": foreign})
    for side in "br":
        step = parts(step, {f"{side}_place": part(r"(?s)^/*([^/]*)", f"{side}_body"), f"{side}_tail": part(r"(?s)^/*[^/]*(.*)$", f"{side}_body")})
        step = parts(step, {f"{side}_user": part(r"(?s)^(.*)@", f"{side}_place"), f"{side}_host": F.lower(part(r"(?s)^(?:.*@)?([^@:]*)(?::\d*)?$", f"{side}_place")), f"{side}_port": part(r"(?s)^(?:.*@)?[^@:]*:(\d*)$", f"{side}_place")})
    scheme = F.when(c("r_special"), c("r_scheme")).otherwise(c("b_scheme"))
    step = parts(step, {"scheme": scheme})

    def authority(side: str, scheme: Column) -> Column:
        port = F.regexp_replace(c(f"{side}_port"), "^0+(?=[0-9])", "")
        default = F.element_at(F.create_map(*(F.lit(x) for pair in (("http", "80"), ("https", "443"), ("ftp", "21"), ("ws", "80"), ("wss", "443")) for x in pair)), scheme)
        user = F.when(c(f"{side}_user").isin("", ":"), "").otherwise(F.concat(c(f"{side}_user"), F.lit("@")))
        return F.concat(scheme, F.lit("://"), user, c(f"{side}_host"), F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)))

    folder = F.concat(F.regexp_extract(F.concat(F.lit("/"), c("b_tail")), "(?s)^/(.*/)?[^/]*$", 1))
    joined = F.when(c("r_body").startswith("/"), c("r_body")).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), c("r_body")))
    own_path = F.when(c("relative") & (c("r_body") == ""), c("b_tail")).when(c("relative"), joined).otherwise(c("r_tail"))
    step = parts(step, {"path": F.when(own_path == "", "/").otherwise(own_path)})
    step = parts(step, {"path": _encoded(_without_dots(c("path")), _PATH_UNSAFE), "query": F.when(c("relative") & (c("r_body") == "") & (F.instr(c("r_rest"), "?") == 0), c("b_query")).otherwise(c("r_query"))})
    url = F.concat(F.when(c("relative"), authority("b", c("b_scheme"))).otherwise(authority("r", c("scheme"))), c("path"), c("query"))
    known = F.when(c("foreign"), F.concat(c("r_scheme"), F.substr(c("r_text"), F.length(c("r_scheme")) + F.lit(1), F.length(c("r_text"))))).otherwise(url)

    def named(side: str) -> Column:
        """A host and a port that need no mapping and can't fail."""
        host = c(f"{side}_host")
        return host.rlike("^[a-z0-9._-]+$") & ~host.rlike(r"(?:^|\.)(?:[0-9]*\.?$|0x[0-9a-f]*\.?$|xn--)") & (F.length(c(f"{side}_port")) <= 4)

    fine = c("b_special") & c("b_scheme").isin("http", "https") & c("b_body").startswith("//") & named("b") & (c("foreign") | c("relative") | named("r"))
    fine = F.coalesce(fine, F.lit(False)) | F.col(raw).isNull() | F.col(base).isNull()
    return step.select(*columns, fine.alias("__fine"), known.alias("__url"))


def display_url(url: Column, limit: int = 64) -> Column:
    """The URL, or its origin with the head and tail of the rest, in ``limit`` characters."""
    own = origin(url)
    room = F.lit(limit - 3) - F.length(own)
    rest = F.substr(url, F.length(own) + F.lit(1), F.length(url))
    head = F.ceil(room / 2).cast("int")
    tail = (room - head).cast("int")
    end = F.when(tail == 0, rest).otherwise(F.substr(rest, F.length(rest) - tail + F.lit(1), tail))  # a tail of none is the whole rest
    return (
        F.when(F.length(url) <= limit, url)
        .when(F.length(own) + 3 >= limit, F.concat(own, F.lit("...")))
        .otherwise(F.concat(own, F.substr(rest, F.lit(1), head), F.lit("..."), end))
    )


def product_token(user_agent: Column) -> Column:
    return F.regexp_extract(user_agent, r"^([^/\s]*)", 1)


def redact_userinfo(text: Column) -> Column:
    """A URL with userinfo shows its scheme and host alone."""
    found = r"^([A-Za-z][A-Za-z0-9+.\-]*)://[^/?#]*@([^/?#]*).*$"
    return F.when(text.rlike(found), F.regexp_replace(text, found, "$1://***@$2/")).otherwise(text)


@F.pandas_udf(T.StringType())
def exact_key(urls):
    from skein.functions import weburl

    return urls.map(weburl.canonical_key)


@F.pandas_udf(T.StringType())
def resolve(raws, bases):
    import pandas as pd

    from skein.functions import weburl

    return pd.Series([None if r is None or b is None else weburl.resolve(r, b) for r, b in zip(raws, bases)], dtype="object")
