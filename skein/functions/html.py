"""Links, base and canonical of a page: by patterns in the JVM where the markup is plain, else by the tokenizer in an Arrow UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import url as urls
from skein.functions.markup import TEXT_ONLY, Head
from skein.sources.staging import arrow_batches, staged

_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TEXT_ONLY = "|".join(["script", *TEXT_ONLY])
#: What no anchor can be in: comments, and elements whose contents are text.
HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<({_TEXT_ONLY})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)|<!doctype[^>]*>"
#: Tags, and those in which no quote or bracket can mislead; anchors, and those whose attributes are all of the form name="value". Repeated groups recurse, so they are bounded.
TAG, FINE_TAG = "<[A-Za-z/]", r"""<[A-Za-z/][^<>"'=]*(?:=\s*(?:"[^"<>]*")?[^<>"'=]*){0,40}>"""
ANCHOR, FINE_ANCHOR = r"(?i)<a(?=[\s/>])", r"""(?i)<a(?:\s+[^\s"'<>/=]+="[^"<>]*"){0,20}\s*>"""


def _plain(bare: Column, html: Column) -> Column:
    """Whether patterns see in the page (bare: without its hidden parts) what the tokenizer sees."""
    odd = (
        html.rlike("<!---?>|--!>|\\x0b") | html.rlike(rf"(?i)</(?:{_TEXT_ONLY})(?:/|\s+[^\s>])") | bare.rlike(rf"(?i)<[!?]|</?(?:base|template|plaintext|{_TEXT_ONLY})(?=[\s/>])")
        | bare.rlike(r"(?i)=\s*\"[^\"]*\shref\s*=") | bare.rlike("(?i)<a[^<>]*&(?!amp;)")
    )
    counted = lambda p: F.regexp_count(bare, F.lit(p))
    return ~odd & (counted(TAG) == counted(FINE_TAG)) & (counted(ANCHOR) == counted(FINE_ANCHOR))


def with_links(pages: DataFrame, html: str, url: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of pages with a row for each anchor's href: pos (from 0), raw, and the base it stands against; staged."""
    keys = [f"__k{i}" for i in range(len(keep))]

    def read(bare: Column) -> Column:
        anchors = F.regexp_extract_all(bare, F.lit(FINE_ANCHOR), F.lit(0))
        hrefs = F.transform(anchors, lambda a: F.replace(F.regexp_extract(a, r"(?i)\shref=\"([^\"]*)\"", 1), F.lit("&amp;"), F.lit("&")))
        return F.struct(_plain(bare, F.col(html)).alias("plain"), F.filter(hrefs, lambda h: h.rlike(rf"[^{_SPACES}]")).alias("hrefs"))

    # Bound to a variable, the page without its hidden parts is made once.
    found = F.transform(F.array(F.regexp_replace(F.col(html), HIDDEN, " ")), read)[0]
    rows = pages.where(F.col(html).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(keep, keys)), F.col(html).alias("__html"), F.col(url).alias("__url"), found.alias("__found"))
    # Of plain pages the links alone are kept.
    rows = staged(rows.select(*keys, "__url", "__found.plain", F.when(F.col("__found.plain"), F.col("__found.hrefs")).alias("hrefs"), F.when(~F.col("__found.plain"), F.col("__html")).alias("__html")), "links")
    kept = [F.col(k).alias(c) for c, k in zip(keep, keys)]

    def fast(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, "__url", F.posexplode("hrefs").alias("pos", "raw")).select(*kept, "pos", "raw", F.col("__url").alias("base"))

    def exact(rows: DataFrame) -> DataFrame:
        read = rows.select(*keys, raw_links(F.col("__html"), F.col("__url")).alias("p"))
        return read.select("*", F.posexplode("p.hrefs").alias("pos", "raw")).select(*kept, "pos", "raw", "p.base")

    return urls.split(rows, F.col("plain"), fast, exact)


def read(html: str, page_url: str) -> dict:
    """links (resolved, without fragments, repeats kept), canonical (raw), base, ignored (reason and raw); error if the page can't be read."""
    try:
        return _read(html, page_url) | {"error": None}
    except Exception as error:  # a page that breaks the tokenizer fails alone
        return {"links": [], "canonical": None, "base": page_url, "ignored": [], "error": str(error) or type(error).__name__}


def _base(page: Head, own):
    """What the page's links stand against: its first base, if that is a URL, else its own."""
    from skein.functions import weburl

    return (weburl.parse(page.base, own) if page.base and page.base.strip() else None) or own


def _read(html: str, page_url: str) -> dict:
    from skein.functions import weburl

    page, own = Head(html), weburl.parse(page_url)
    base = _base(page, own)
    links, ignored = [], []
    for raw in page.hrefs:
        url = weburl.parse(raw, base)
        problem = "unparsable" if url is None else "scheme" if url.scheme not in ("http", "https") else "userinfo" if url.user else None
        if problem:
            ignored.append({"reason": problem, "raw": re.sub(r"[\r\n]+", " ", raw)})
        else:
            links.append(str(url))
    return {"links": links, "canonical": page.canonical, "base": str(base), "ignored": ignored}


_TEXT = T.StringType()


@F.pandas_udf(T.StructType([T.StructField("hrefs", T.ArrayType(_TEXT)), T.StructField("base", _TEXT)]))
def raw_links(bodies, pages):
    import pandas as pd

    from skein.functions import weburl
    from skein.functions.html import _base
    from skein.functions.markup import Head

    def read(body, url):
        page, own = Head(body), weburl.parse(url) if url is not None else None
        base = _base(page, own)
        return page.hrefs, url if base is None or base is own else str(base)

    return pd.DataFrame([read(b, u) for b, u in zip(bodies, pages)], columns=["hrefs", "base"])


_IGNORED = T.StructType([T.StructField("reason", _TEXT), T.StructField("raw", _TEXT)])
#: A type, not its DDL: workers import this module without a session.
SCHEMA = T.StructType([T.StructField("links", T.ArrayType(_TEXT)), T.StructField("canonical", _TEXT), T.StructField("base", _TEXT), T.StructField("ignored", T.ArrayType(_IGNORED)), T.StructField("error", _TEXT)])


def with_page(pages: DataFrame, html: str, url: str, name: str) -> DataFrame:
    """Adds what ``read`` finds in each page, instead of its html; staged, in batches of few bytes, so that no worker holds many pages."""
    with arrow_batches(pages.sparkSession):
        read = pages.select(*(c for c in pages.columns if c != html), read_html(F.col(html), F.col(url)).alias(name))
        return staged(read, "read")


@F.pandas_udf(SCHEMA)
def read_html(bodies, urls):
    import pandas as pd

    from skein.functions.html import read as read_page

    return pd.DataFrame([read_page(b or "", u) for b, u in zip(bodies, urls)], columns=["links", "canonical", "base", "ignored", "error"])
