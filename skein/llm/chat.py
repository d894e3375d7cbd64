"""Chat formatting: cumulative snapshots collapse to the longest logged conversation.

All turns are put in one order, by conversation and turn, that is dealt by range: a conversation of
very many turns lies over several partitions, and running totals are carried over from one to the
next. A conversation's prefix hash after k turns is the sum, in two independent sums, of hashes of (place, role, text) of its first k turns: the running total there less the one
before its first turn. A conversation whose hash is a prefix hash of a longer one is a snapshot of it
and goes, by an anti-join; of equal conversations the one with the smallest conv_id stays. What stays
is rendered as ChatML-like text.

Turns are ordered by turn (nulls last), then role and text; rows repeated in all four columns count
once. A null role is "unknown", a null text empty; a null conv_id is a conversation of its own, which
yields to equal ones with an id. A conversation is one row; only one whose text is longer than
PART_BYTES is cut into parts between turns. An empty table gives an empty result. Only conv_id, turn,
role and text are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Bytes of text after which a conversation's next turn begins another row: a string has an end in Spark.
PART_BYTES = 256 << 20
START, END = "<|im_start|>", "<|im_end|>\n"


def _hash(seed: int) -> Column:
    """A hash of a turn at its place, as a number below 2^62 so that sums of many stay exact as decimals."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place", f"h{seed}"), 2).cast("decimal(20,0)")


def _rendered() -> Column:
    return F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END))


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]


def _since_start(rows: DataFrame, names: list[str]) -> DataFrame:
    """Takes from each running total (of ``names``) the one at the conversation's first row; ids may be null."""
    least = F.min(F.struct("rank", *names)).alias("first")
    starts = common.staged(rows.groupBy(F.col("conv_id").alias("c")).agg(least).select("c", *(F.col(f"first.{n}").alias(f"s_{n}") for n in ["rank", *names])), "starts")
    joined = rows.join(starts, rows["conv_id"].eqNullSafe(F.col("c")))
    return joined.withColumns({n: F.col(n) - F.col(f"s_{n}") for n in names}).withColumn("place", F.col("rank") - F.col("s_rank") + 1).drop("c", *(f"s_{n}" for n in ["rank", *names]))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their rank in the whole order, their place (from 1) in the conversation and the bytes before them there; staged."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), common.text_or_empty().alias("text")).distinct()
    size = F.octet_length(_rendered()).cast("bigint")
    ranked = common.staged(common.running(rows, _order(), {"bytes": size}), "ranked_turns")
    return common.staged(_since_start(ranked, ["bytes"]), "turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, place and the hashes x and y of the first ``place`` turns, from numbered turns."""
    hashed = rows.select("conv_id", "rank", "place", *(F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (1, 2)))
    hashed = hashed.select("conv_id", "rank", "place", _hash(1).alias("x"), _hash(2).alias("y")).withColumnRenamed("rank", "at")
    # "rank" again: the same order, as at is unique.
    totals = common.staged(common.running(hashed, ["at"], {"bx": F.col("x"), "by": F.col("y")}), "totals")
    since = _since_start(totals, ["bx", "by"])
    return since.select("conv_id", "place", *((F.col(f"b{h}") + F.col(h)).cast("string").alias(h) for h in ("x", "y")))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay, from numbered turns."""
    every = common.staged(prefixes(rows), "prefixes")
    other = common.staged(every.groupBy(F.col("conv_id").alias("c")).agg(F.max("place").alias("last")), "ends")
    marked = common.staged(every.join(other, every["conv_id"].eqNullSafe(F.col("c"))).drop("c"), "marked")
    whole = marked.where("place = last").groupBy("place", "x", "y").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where("place < last").select("place", "x", "y").distinct()
    return whole.join(inner, ["place", "x", "y"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text: the maximal conversations as text; staged. Part is 0 but for parts that follow."""
    with common.scratch() as keep:
        rows = numbered(turns)
        kept = common.staged(maximal(rows), "maximal").withColumnRenamed("conv_id", "c")
        rows = rows.join(kept, rows["conv_id"].eqNullSafe(F.col("c"))).drop("c")
        part = F.floor(F.col("bytes") / F.lit(PART_BYTES)).cast("bigint").alias("part")
        lines = F.array_sort(F.collect_list(F.struct("place", _rendered().alias("t"))))
        parts = rows.groupBy("conv_id", part, "n_turns").agg(F.array_join(F.transform(lines, lambda s: s["t"]), "").alias("text"))
        return keep(parts.select("conv_id", "part", F.col("n_turns").cast("bigint").alias("n_turns"), "text"), "chats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(common.table(spark, sf_dir, "conversations"))


SQL = rf"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT *, row_number() OVER w AS place, string_agg(md5(role || chr(31) || text), '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id FROM p WHERE place = n GROUP BY prefix
), kept AS (
  SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n)
)
SELECT p.conv_id, CAST(0 AS BIGINT) AS part, CAST(max(n) AS BIGINT) AS n_turns,
  string_agg('{START}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM p JOIN kept USING (conv_id) GROUP BY p.conv_id
"""
