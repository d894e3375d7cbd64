"""A stored web in the crawl's own layout: pages and links in buckets by URL.

A crawl joins its generations to the same web again and again. In buckets the web is exchanged once,
and afterwards only the generation moves. Links are rows, as a page of a relational site may have any
number of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.staging import remove, shared_path


@dataclass
class StoredWeb:
    """pages: a row for each URL, with n_links; links: from_url, n (its place on the page), url, key."""

    pages: DataFrame
    links: DataFrame
    tables: tuple = ()

    def drop(self) -> None:
        spark = self.pages.sparkSession
        for name, path in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)


def _bucketed(df: DataFrame, key: str) -> tuple[DataFrame, tuple[str, str]]:
    spark = df.sparkSession
    name, path = f"skein_web_{uuid.uuid4().hex}", shared_path(spark, "web")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name), (name, path)


def stored(web: DataFrame | StoredWeb) -> StoredWeb:
    """Writes a web in buckets; of a plain table, ``links`` is an array of structs of url and key."""
    if isinstance(web, StoredWeb):
        pages, first = _bucketed(web.pages, "url")
        links = web.links
    else:
        # Pages are written with their arrays, so that bodies are parsed once.
        pages, first = _bucketed(web.withColumn("n_links", F.size("links")), "url")
        links = pages.select(F.col("url").alias("from_url"), F.posexplode("links").alias("n", "link")).select("from_url", "n", "link.url", "link.key")
        pages = pages.drop("links")
    links, second = _bucketed(links, "from_url")
    return StoredWeb(pages, links, (first, second))
