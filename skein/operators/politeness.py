"""When requests may start: in closed form for one lease, by simulation for several."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.staging import ranked, staged


def start_times(requests: DataFrame, key: str, ready: str, gap: Column, order: list[str]) -> DataFrame:
    """Adds start_ms: start = max(ready, start before + larger of the two gaps); order must be total within a key.

    With C the running sum of gaps, start - C is the running maximum of ready - C. All requests are put
    in one order by key, dealt by range: an origin with most of the requests lies over many partitions.
    What a partition takes over from those before it, for the key they share, is a row a partition.
    """
    rows = requests.withColumn("_gap", gap)
    # The row before the first of a partition is the last one of an earlier partition: they meet among the edges.
    parts = staged(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "paced")
    own = Window.partitionBy("_part").orderBy(key, *order)
    mine = Window.partitionBy("_part", key).orderBy(*order)
    edge = parts.groupBy("_part").agg(F.max(F.struct(key, *order, "_gap")).alias("e")).select("_part", F.col(f"e.{key}").alias("_last_key"), F.col("e._gap").alias("_last_gap"))
    earlier = Window.orderBy("_part")
    edge = edge.select((F.lead("_part").over(earlier)).alias("_part"), "_last_key", "_last_gap").where("_part IS NOT NULL")
    w = parts.join(F.broadcast(edge), "_part", "left")
    first_row = F.row_number().over(own) == 1
    before = F.coalesce(F.lag("_gap").over(mine), F.when(first_row & F.col(key).eqNullSafe(F.col("_last_key")), F.col("_last_gap")))
    w = w.withColumn("_step", F.when(before.isNull(), 0).otherwise(F.greatest("_gap", before)))
    w = w.withColumn("_sum", F.sum("_step").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    w = staged(w.withColumn("_top", F.max(F.col(ready) - F.col("_sum")).over(mine.rowsBetween(Window.unboundedPreceding, 0))).drop("_last_key", "_last_gap"), "stepped")
    # A key that goes on in later partitions hands over its sum, and its top seen from there.
    sums = w.groupBy(key, "_part").agg(F.max("_sum").alias("s"), F.max("_top").alias("t"))
    spread = sums.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n")).where("n > 1")
    sums = sums.join(spread, sums[key].eqNullSafe(F.col("_k")), "left_semi")  # two rows a partition at most
    over = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_add", F.coalesce(F.sum("s").over(over), F.lit(0)))
    sums = sums.withColumn("_floor", F.max(F.col("t") - F.col("_add")).over(over)).select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_add", "_floor")
    out = w.join(F.broadcast(sums), w[key].eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    add = F.coalesce("_add", F.lit(0))
    start = F.col("_sum") + add + F.greatest(F.col("_top") - add, F.coalesce("_floor", F.col("_top") - add))
    return out.withColumn("start_ms", start).drop("_gap", "_step", "_sum", "_top", "_part", "_k", "_p", "_add", "_floor")


def lease_times(requests: DataFrame, key: str, limit: int, gap_ms: int) -> DataFrame:
    """(key, id, ready_ms, hold_ms) -> take_ms, start_ms where ``limit`` leases a key are held in order of arrival.

    Each start depends on the one before, so a key's requests go through one task, in order and as a
    stream: what is held is the leases' ends, whatever the number of requests.
    """

    def run(frames):
        now, held, last = object(), [], None
        for frame in frames:
            takes, starts = [], []
            for own, ready, hold in zip(frame[key], frame["ready_ms"].tolist(), frame["hold_ms"].tolist()):
                if own != now:
                    now, held, last = own, [], None
                take = ready if len(held) < limit else max(ready, heapq.heappop(held))
                last = take if last is None else max(take, last + gap_ms)
                heapq.heappush(held, last + hold)
                takes.append(take)
                starts.append(last)
            yield frame.assign(take_ms=takes, start_ms=starts)

    kind = dict(requests.dtypes)[key]
    rows = requests.select(key, "id", F.col("ready_ms").cast("bigint"), F.col("hold_ms").cast("bigint"))
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, "ready_ms", "id")
    return sorted_rows.mapInPandas(run, f"{key} {kind}, id bigint, ready_ms bigint, hold_ms bigint, take_ms bigint, start_ms bigint")


def budget_cut(claims: DataFrame, order: list, most: int) -> DataFrame:
    """Attempt claims in order: granted as long as fewer than ``most`` were before."""
    return ranked(claims, order, "claim").withColumn("granted", F.col("claim") < most)
