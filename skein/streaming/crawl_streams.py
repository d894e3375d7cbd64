"""The crawl's keyed state over streams: first sight of keys, pacing by origin, outcome counts.

Each takes and returns a streaming (or plain) DataFrame. State lives in Spark's state store and is
recovered from the query's checkpoint; with many keys, set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import url


def first_seen(links: DataFrame, link: str = "url", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Adds ``key`` and keeps the first row of each; rows without a key go.

    Without event_time, all keys are remembered for ever. With it a key is forgotten ``delay`` after
    its row, so the state is bounded.
    """
    # A stream is read once: its rows aren't split by what their keys need.
    keyed = links.withColumn("key", url.canonical_key(F.col(link))) if links.isStreaming else url.with_key(links, link, "key")
    rows = keyed.where("key IS NOT NULL")
    if event_time is None:
        return rows.dropDuplicates(["key"])
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])


def paced(requests: DataFrame, key: str, ready: str, gap: Column, tie: str) -> DataFrame:
    """key, tie, ready_ms and start_ms = max(ready, start before + larger of the two gaps).

    The state of a key is one start and one gap. Within a batch a key's requests go by (ready, tie);
    a request that comes in a later batch starts after those of earlier ones, whatever its ready time.
    """
    kinds = dict(requests.dtypes)
    rows = requests.select(key, tie, F.col(ready).cast("bigint").alias("ready_ms"), gap.cast("bigint").alias("gap_ms"))

    def run(_, frames, state):
        import pandas as pd

        last, before = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values(["ready_ms", tie], kind="stable")
        starts = []
        for at, own in zip(frame["ready_ms"].tolist(), frame["gap_ms"].tolist()):
            last = at if last is None else max(at, last + max(before, own))
            before = own
            starts.append(last)
        state.update((last, before))
        yield frame.assign(start_ms=starts).drop(columns="gap_ms")

    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, ready_ms bigint, start_ms bigint"
    return rows.groupBy(key).applyInPandasWithState(run, out, "last bigint, gap bigint", "append", "NoTimeout")


def outcome_counts(pages: DataFrame, event_time: str, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """start, state, n: pages by state in tumbling windows; a window is final ``delay`` after its end."""
    rows = pages.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "state").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "state", "n")
