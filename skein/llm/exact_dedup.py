"""Exact dedup with a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to its digests, those
that the index lacks are found by a sort-merge anti-join, and only they are appended.

Null texts count as empty. White space never matters. Of equal texts, the row with the most
code points stays, then the smallest doc_id (nulls last), then the first row as staged: of
repeated rows exactly one stays. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest (32 bytes) and a number for each row, staged; whole texts are read once."""
    text = common.text_or_empty()
    return common.staged(
        docs.select(
            "doc_id",
            F.char_length(text).alias("n_chars"),
            F.unhex(F.sha2(F.translate(text, common.SPACE, ""), 256)).alias("digest"),
            common.id_key().alias(common.ID_KEY),
            common.text_key().alias(common.TEXT_KEY),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )


class DigestIndex:
    """A table (digest, keep_id, batch) below ``path``, in buckets sorted by digest.

    The folder persists, and another session opens it again by its path. Its layout is written beside
    the files: opening it with other buckets, or another type of id, is refused. Each batch adds a
    file to a bucket; ``compact`` makes one of them again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type
        self.layout = f"{path}/layout"
        known = self._layout()
        if known is None:
            self._write_layout(0)
            known = self._layout()
        if (known["buckets"], known["id_type"]) != (buckets, id_type):
            raise ValueError(f"the index in {path} has {known['buckets']} buckets and ids of type {known['id_type']}, not {buckets} and {id_type}")
        self._open(known["generation"])

    def _layout(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.layout)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema("generation int, buckets int, id_type string").json(self.layout).orderBy(F.desc("generation")).first()

    def _write_layout(self, generation: int) -> None:
        self.spark.range(1).select(F.lit(generation).alias("generation"), F.lit(self.buckets).alias("buckets"), F.lit(self.id_type).alias("id_type")).coalesce(1).write.mode("append").json(self.layout)

    def _open(self, generation: int) -> None:
        self.generation, place = generation, f"{self.path}/generation-{generation}"
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, place).hex}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def compact(self) -> None:
        """One sorted file a bucket, as a new generation; the old one stays valid until the layout names the new one, then goes."""
        old, place = self.table, f"{self.path}/generation-{self.generation}"
        # Read as plain files: of a bucketed table the planner would leave the exchange out.
        rows = self.spark.read.schema(self.read().schema).parquet(place)
        self._open(self.generation + 1)
        rows.repartition(self.buckets, "digest").write.mode("overwrite").insertInto(self.table)
        self._write_layout(self.generation)
        self.spark.catalog.refreshTable(self.table)
        self.spark.sql(f"DROP TABLE {old}")
        common.remove(self.spark, place)

    def drop(self) -> None:
        """Deletes the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        common.remove(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Dedups docs against the index and itself and appends what is new.

        Returns a row for each row of docs: doc_id, keep_id, group_size (rows of this batch with
        that text), kept, digest and the row's keys. A batch that is added again under its name
        gets the same result, so a failed job can be rerun.
        """
        rows = digest_rows(docs)
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
        groups = common.staged(rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
        dealt = groups.repartition(self.buckets, "digest")
        fresh = dealt.join(self.read().hint("merge"), "digest", "left_anti")
        fresh.select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        known = common.staged(
            dealt.join(self.read().hint("merge"), "digest").select(
                "digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("best.row_no")).alias("kept_row")
            ),
            "known",
        )
        # Both sides are plain scans: the planner can split the partition of a text with very many copies.
        return rows.join(known, "digest").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("kept_row"), F.lit(False)).alias("kept"),
            "digest", common.ID_KEY, common.TEXT_KEY,
        )


def new_index(docs: DataFrame) -> DigestIndex:
    """An empty index in the shared folder, with a bucket for each shuffle partition."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, common.shared_path(spark, "digest_index"), buckets, dict(docs.dtypes)["doc_id"])


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "first") -> DataFrame:
    """Dedups docs against an index, or by themselves with one that goes afterwards; staged."""
    with common.scratch() as keep:
        own = index or new_index(docs)
        out = keep(own.add(docs, batch), "deduplicated")
        if index is None:
            own.drop()
        return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return common.rows_of(docs, exact_dedup(docs).where("kept"), distinct=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS r,
    first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, h AS text_sha256 FROM w
"""
