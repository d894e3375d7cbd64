"""Pacing in the order of event time, by a stateful processor with typed state and timers.

A request waits in its key's map state, by slots of time, until the watermark has passed its slot; a
timer then lets the slot's requests start in the order of (ready, tie). So starts don't depend on how
the stream was cut into batches, a restart goes on from the checkpoint, and what a task holds at once
is one slot of one key. A key that has been idle for a day is forgotten. The state store must be
RocksDB: ``with rocksdb(spark): ...``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of a slot, and after which an idle key is forgotten.
SLOT, IDLE = 1000, 24 * 3600 * 1000


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Pacer(StatefulProcessor):
    """Starts of one key's requests: max(ready, start before + larger of the two gaps)."""

    def __init__(self, slot: int = SLOT, idle: int = IDLE):
        self.slot, self.idle = slot, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start bigint, gap bigint")
        self.waiting = handle.getMapState("waiting", "slot bigint", "ready array<bigint>, gap array<bigint>, tie array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        slots: dict[int, list] = {}
        for r in rows:
            slots.setdefault(r["ready_ms"] // self.slot, []).append((r["ready_ms"], r["gap_ms"], r["tie"]))
        for slot, new in slots.items():
            old = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else ([], [], [])
            self.waiting.updateValue((slot,), tuple([*o, *n] for o, n in zip(old, zip(*new))))
            self.handle.registerTimer((slot + 1) * self.slot)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        slot = at // self.slot - 1
        if not self.waiting.containsKey((slot,)):
            if self.last.exists() and self.last.get()[0] + self.idle <= at:
                self.last.clear()
            return
        requests = sorted(zip(*self.waiting.getValue((slot,))), key=lambda r: (r[0], len(r[2]), r[2]))
        self.waiting.removeKey((slot,))
        start, before = self.last.get() if self.last.exists() else (None, 0)
        for ready, gap, tie in requests:
            start = ready if start is None else max(ready, start + max(before, gap))
            before = gap
            yield Row(key=key[0], tie=tie, ready_ms=ready, start_ms=start)
        self.last.update((start, before))
        self.handle.registerTimer((max(start, at) + self.idle) // self.slot * self.slot + self.slot)

    def close(self) -> None:
        pass


def paced(requests: DataFrame, key: str, ready: str, gap: Column, tie: str, delay: str = "10 seconds") -> DataFrame:
    """key, tie (as a string), ready_ms and start_ms of a stream whose column ``ready`` is a timestamp.

    Of equal ready times, the shorter tie comes first, then the smaller one, which is the order of numbers.
    A request that comes more than ``delay`` behind the latest one is late and goes.
    """
    rows = requests.withWatermark(ready, delay)
    rows = rows.select(F.col(ready), F.col(key).cast("string").alias("key"), F.col(tie).cast("string").alias("tie"), F.unix_millis(ready).alias("ready_ms"), gap.cast("bigint").alias("gap_ms"))
    return rows.groupBy("key").transformWithState(Pacer(), "key string, tie string, ready_ms bigint, start_ms bigint", "append", "eventTime")
