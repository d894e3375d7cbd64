"""What the corpus operators share: row keys, Arrow batches, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.shipping import ship  # noqa: F401
from skein.sources.staging import arrow_batches, remove, running, scratch, shared_path, staged  # noqa: F401

#: The white space of every word definition here: space and U+0009 to U+000D.
SPACE = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
#: Names of the keys; rows of the input stand beside them as a struct.
ID_KEY, TEXT_KEY = "__skein_id", "__skein_text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(rows: DataFrame, function, schema: str, name: str, batch_rows: int = 500) -> DataFrame:
    """rows.mapInArrow(function, schema), staged, in small batches."""
    with arrow_batches(rows.sparkSession, batch_rows):
        return staged(rows.mapInArrow(function, schema), name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_key() -> Column:
    """doc_id as a string that is never null, for joins on it."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000"))


def text_key() -> Column:
    return F.xxhash64(F.col("text"))


def unit_hash(row_no: str = "row_no") -> Column:
    """A number from 0 to 1 for each row, by doc_id, text and the row's number: rows with one doc_id, or none, are sampled one by one."""
    return F.pmod(F.xxhash64("doc_id", "text", row_no), F.lit(1 << 30)) / float(1 << 30)


def keyed(docs: DataFrame) -> DataFrame:
    """The keys of each row, and the whole row as one struct, so that no name of docs can clash."""
    return docs.select(id_key().alias(ID_KEY), text_key().alias(TEXT_KEY), F.struct("*").alias("row"))


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: both are exchanged, as a broadcast passes one of them whole through the driver.

    Packed as Parquet, a table below the planner's limit for broadcasts may need many times that in memory.
    """
    return left.join(right.hint("merge"), on, how)


def rows_of(docs: DataFrame, keys: DataFrame, distinct: bool) -> DataFrame:
    """The rows of docs whose (ID_KEY, TEXT_KEY) is in keys, with the columns of docs.

    distinct: of rows equal in both, one stays. Both steps use one exchange of docs.
    """
    out = joined(keyed(docs), keys.select(ID_KEY, TEXT_KEY), [ID_KEY, TEXT_KEY], "left_semi")
    if distinct:
        out = out.dropDuplicates([ID_KEY, TEXT_KEY])
    return out.select("row.*")
