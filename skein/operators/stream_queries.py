"""Queries that run streams over a stored table to its end, with state in the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import html
from skein.operators.queries import _KEY, _LINKS, SQL, query
from skein.shipping import ship
from skein.sources.staging import arrow_batches, passing
from skein.streaming import crawl_streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A file source takes a pattern, also of a single file or folder.
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(rows: DataFrame, mode: str) -> DataFrame:
    """Writes all of a stream's results to the shared folder and reads them."""
    spark, path = rows.sparkSession, passing(rows.sparkSession, "stream")
    ship(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'result' if mode == 'complete' else number}")

    # A stream keeps the settings it starts with: small batches, so that no worker holds many pages.
    with arrow_batches(spark):
        rows.writeStream.outputMode(mode).option("checkpointLocation", passing(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)


@query(SQL["q_politeness_start"])
def q_stream_paced(spark, sf_dir):
    """Starts of requests by the state of their key: its last start and gap."""
    rows = _stream(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ready"))
    paced = crawl_streams.paced(rows, "user_id", "ready", F.lit(60000) + 1000 * (F.col("event_id") % 7), "event_id")
    return _run(paced, "append").select("event_id", "start_ms")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS state, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def q_stream_outcomes(spark, sf_dir):
    """Counts by state in windows of an hour."""
    rows = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("state"))
    out = _run(crawl_streams.outcome_counts(rows, "at", "1 hour"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "state", "n")


@query(f"SELECT DISTINCT {_KEY} AS key FROM ({_LINKS})")
def q_stream_first_seen(spark, sf_dir):
    """The first sight of each link's key."""
    pages = _stream(spark, sf_dir, "pages")
    rows = pages.select(F.explode(html.read_html(F.col("html"), F.col("url"))["links"]).alias("url"))
    return _run(crawl_streams.first_seen(rows), "append").select("key")
