"""Pages go to Python workers in small batches, also where a result is read lazily or by a stream."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skein.functions import html
from skein.operators import stream_queries

SF = "/root/testdata/sf0.1"


@F.pandas_udf(LongType())
def together(bodies: pd.Series, urls: pd.Series) -> pd.Series:
    """Of each row, how many rows came in its batch."""
    return pd.Series([len(bodies)] * len(bodies))


def test_pages_read_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(html, "read_html", together)
    out = html.with_page(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"), "html", "url", "n")
    assert out.columns == ["page_id", "url", "n"] and out.agg(F.count("*"), F.max("n") <= 500).first()[:] == (2500, True)


def test_streams_read_in_small_batches(spark):
    rows = stream_queries._stream(spark, SF, "pages").select(together("html", "url").alias("n"))
    assert stream_queries._run(rows, "append").agg(F.count("*"), F.max("n") <= 500).first()[:] == (2500, True)
