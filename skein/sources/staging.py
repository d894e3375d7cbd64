"""Tables written once to the folder all executors share, and a distributed total order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="skein-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch():
    """What is staged inside goes at the end, but for the tables handed to the function it gives.

    A kept table is complete in the shared folder, so nothing has to be computed again from those that went.
    """
    _SCRATCH.append([])
    kept: set[str] = set()

    def keep(df: DataFrame, name: str = "result") -> DataFrame:
        out = staged(df, name)
        kept.add(_SCRATCH[-1][-1][1])
        return out

    try:
        yield keep
    finally:
        made = _SCRATCH.pop()
        for spark, path in made:
            if path not in kept:
                remove(spark, path)
            elif _SCRATCH:
                _SCRATCH[-1].append((spark, path))


def passing(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes as staged tables do."""
    path = shared_path(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append((spark, path))
    return path


def held() -> bool:
    """Whether anything has been staged in the innermost scratch."""
    return bool(_SCRATCH and _SCRATCH[-1])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it again.

    It cuts the lineage: a lost executor costs a read of this table, not the work behind it.
    """
    spark = df.sparkSession
    path = passing(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list, sums: dict[str, Column], name: str = "rank") -> DataFrame:
    """Adds a row's place in the order (from 0) as ``name``, and for each of ``sums`` its total over the rows before.

    The order must be total. Rows are dealt by range and numbered within partitions, so that a value
    that many rows share does not make a task large; one row a partition meets in one place.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    totals = parts.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__n", *(f"__{k}" for k in sums))))
    own = Window.partitionBy("__part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    values = {name: F.row_number().over(own) - 1 + F.col("__n")}
    values |= {k: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__{k}") for k, c in sums.items()}
    return parts.join(F.broadcast(totals), "__part").withColumns(values).drop("__part", "__n", *(f"__{k}" for k in sums))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20):
    """Inside, Arrow batches have few rows and bytes, so that long texts don't pile up in a worker.

    The session's own settings come back at the end, so what is planned inside must also run inside.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ranked(df: DataFrame, order: list[Column | str], name: str, weight: Column | None = None, before: str = "before") -> DataFrame:
    """Adds a position in the total order (from 0) as ``name``, and with weight also the running sum before each row."""
    return running(df, order, {} if weight is None else {before: weight.cast("bigint")}, name)
