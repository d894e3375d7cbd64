"""From raw documents to token counts of a deduplicated mix, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept; all but the
last return the columns of documents. ``run`` applies them to the documents table and writes each
stage's result as Parquet, which the next one reads. Null and empty texts have too few words and go in
the first stage; texts of any length are worked on whole; of repeated rows one stays, which the mix may
repeat again. An empty table goes through as one. Other columns are carried along to the mix, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, common, exact_dedup, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; those of a language without a reference are judged by the base rules alone."""
    common.ship(spark)
    return quality.passed(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text but for white space, one stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8), the document with the smallest doc_id stays.

    Null doc_ids come last; groups without a doc_id, or with the same one, each keep a row of their own.
    """
    common.ship(spark)
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row of the mix."""
    common.ship(spark)
    return bpe.digests(docs)


STAGES = [("quality", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: SQL can't express the quality distances' references, components or the encoder: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote before goes at the end."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch() as keep:
        for name, stage in STAGES[:-1]:
            docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), f"stage-{name}")
