import random

from pyspark.sql import functions as F

from skein.shipping import ship
from skein.streaming import pacing

SCHEMA = "origin string, id bigint, ready bigint, gap bigint"


def expected(rows):
    out = []
    for origin in {r[0] for r in rows}:
        start, before = None, 0
        for _, i, ready, gap in sorted((r for r in rows if r[0] == origin), key=lambda r: (r[2], r[1])):
            start = ready if start is None else max(ready, start + max(before, gap))
            before = gap
            out.append((origin, i, ready, start))
    return sorted(out)


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Batches in two runs of the query with one checkpoint give what one look at all rows gives; state is read back."""
    ship(spark)
    r = random.Random(4)
    rows = sorted(((r.choice(["hot"] * 5 + ["a", "b"]), i, 1_000_000 + r.randrange(20000), r.choice([50, 200, 700])) for i in range(300)), key=lambda x: x[2] // 4000)
    end = ("end", 999, 10_000_000, 0)  # moves the watermark behind all others
    inputs, out = tmp_path / "in", str(tmp_path / "out")
    inputs.mkdir()

    def put(n, some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{inputs}/{n}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(inputs))
        paced = pacing.paced(stream.withColumn("at", F.timestamp_millis("ready")), "origin", "at", F.col("gap"), "id")
        paced.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((x.key, int(x.tie), x.ready_ms, x.start_ms) for x in spark.read.parquet(out).collect())

    with pacing.rocksdb(spark):
        for n in range(3):
            put(n, rows[n * 60 : n * 60 + 60])
        half = run()
        assert 0 < len(half) < 300 and set(half) <= set(expected(rows))
        held = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "state")).count()
        assert held == len({x[0] for x in half})
        put(3, rows[180:])
        put(4, [end])
        put(5, [("hot", 1000, 1_000_001, 5)])  # late
        assert run() == expected(rows)
