"""Text of any size written in order: numbered parts whose names, in order, make up one file, and a manifest.

Rows are dealt by range, so no task and no driver holds the whole. The manifest is written last: a
folder without one is an attempt that failed, and is written again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write(lines: DataFrame, order: str, line: str, path: str, head: str | None = None, tail: str | None = None) -> None:
    """Writes the lines by their order (a number, each once), between a head and a tail; refused where a finished one stands."""
    spark = lines.sparkSession
    if _exists(spark, f"{path}/{MANIFEST}"):
        raise FileExistsError(path)
    rows = lines.select(F.lit(1).alias("place"), F.col(order).cast("bigint").alias("ord"), F.col(line).alias("value"))
    ends = [(place, 0, text) for place, text in ((0, head), (2, tail)) if text is not None]
    if ends:
        rows = rows.unionByName(spark.createDataFrame(ends, "place int, ord bigint, value string"))
    rows.repartitionByRange("place", "ord").sortWithinPartitions("place", "ord").select("value").write.mode("overwrite").text(path)
    name = F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    parts = spark.read.text(path).select(name.alias("part"), (F.octet_length("value") + 1).alias("bytes")).groupBy("part").agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))
    # A row for each part.
    number = F.row_number().over(Window.orderBy("part")) - 1
    parts.withColumn("number", number).coalesce(1).write.json(f"{path}/{MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """number, part, lines, bytes of a finished folder."""
    return spark.read.schema("number int, part string, lines bigint, bytes bigint").json(f"{path}/{MANIFEST}")


def read(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines in their order, a part at a time."""
    for row in manifest(spark, path).orderBy("number").toLocalIterator():
        yield from (r[0] for r in spark.read.option("wholetext", "false").text(f"{path}/{row['part']}").coalesce(1).toLocalIterator())
