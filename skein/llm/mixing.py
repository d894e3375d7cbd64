"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash and a size in words. Sizes are summed by source and hash bucket; running sums
show the bucket in which a source's budget ends; only the rows of that bucket are summed again by the
next bits, and so on. What is left is one threshold a source, and rows are taken by a comparison,
without a sort of the corpus.

A source whose target is r times its size gives every row floor(r) times, and the rows under the
threshold once more. The hash is that of doc_id. Where several rows have one doc_id, or none, it is
that of the whole row and its number among the rows equal to it, so that they aren't taken together.
Null texts have size 0 and add no words; a null source is a source of its own, ordered last. Texts of
any length are read whole. Repeated rows are taken each by itself. An empty table gives an empty
result. Other columns are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

WEIGHTS = (5, 2, 1)
#: No document is repeated more often than this.
MOST = 3
#: Hash bits: in all (15 hex digits of an MD5), and by level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 12
#: A boundary bucket with fewer rows a source than this is summed by the whole hash.
EXACT_ROWS = 4096


def hash_bits(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also source_no and target.

    Targets share all words by weight; none is above ``most`` times its source's size. That is the
    fixed point of sharing the excess again: with sources in the order of most * size / weight, the
    first ones get their cap, and the others a share of the rest by weight.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    w = common.running(sizes, [F.col("source").isNull(), F.col("source")], {}, "source_no")
    w = w.withColumn("source_no", F.col("source_no").cast("bigint")).withColumn("weight", weight)
    w = common.staged(w.withColumns({"cap": F.col("source_size") * most, "level": F.col("source_size") * most / F.col("weight")}), "weighted")
    total, heavy = w.agg(F.sum("source_size"), F.sum("weight")).first()
    w = common.running(w, ["level", "source_no"], {"capped": F.col("cap"), "lighter": F.col("weight")})
    w = common.staged(w.withColumns({"rest": F.lit(total or 0) - F.col("capped"), "heavy": F.lit(heavy or 0) - F.col("lighter")}), "shares")
    # Where the first source is below its cap.
    below = w.where(F.col("rest") <= F.col("level") * F.col("heavy")).agg(F.min(F.struct("level", "source_no", "rest", "heavy"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if below is None else F.least(cap, F.col("weight") * F.lit(below["rest"]).cast("double") / F.lit(below["heavy"]))
    return w.select("source", "source_no", "source_size", F.coalesce(target, cap).alias("target"))


def _boundary(level: DataFrame) -> DataFrame:
    """Of each source, the bucket in which its budget ends, with the words below it."""
    up = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    w = level.withColumn("upto", F.sum("words").over(up)).withColumn("below", F.col("upto") - F.col("words"))
    return w.where((F.col("below") <= F.col("need")) & (F.col("need") < F.col("upto")))


def thresholds(rows: DataFrame) -> DataFrame:
    """Of rows (source_no, size, h, need): source_no -> cut; the hashes below it sum up to need, as near as can be."""
    prefix, bits = None, 0
    while True:
        bits += LEVEL_BITS
        rest = HASH_BITS - bits
        level = rows.withColumn("base", F.lit(0).cast("bigint")) if prefix is None else _within(rows, prefix, rest + LEVEL_BITS)
        sums = level.groupBy("source_no", F.shiftright("h", rest).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.first("base").alias("base"), (F.first("need") - F.first("base")).alias("need")
        )
        prefix = common.staged(_boundary(sums).select("source_no", F.col("bucket").alias("prefix"), "n", (F.col("base") + F.col("below")).alias("base")), "boundary")
        most = prefix.agg(F.max("n")).first()[0]
        if most is None or most <= EXACT_ROWS or rest == 0:
            break
    by_hash = _within(rows, prefix, rest).groupBy("source_no", F.col("h").alias("bucket")).agg(
        F.sum("size").alias("words"), (F.first("need") - F.first("base")).alias("need")
    )
    # The hash that crosses the budget is taken too if that comes nearer to it.
    nearer = F.col("upto") - F.col("need") < F.col("need") - F.col("below")
    return _boundary(by_hash).select("source_no", (F.col("bucket") + F.when(nearer, 1).otherwise(0)).alias("cut"))


def _within(rows: DataFrame, prefix: DataFrame, shift: int) -> DataFrame:
    """The rows of each source's boundary bucket; prefix has a row a source."""
    return rows.join(prefix.select("source_no", "prefix", "base"), "source_no").where(F.shiftright("h", shift) == F.col("prefix"))


#: A row's identity: rows equal in it are copies of one another.
ROW_KEY = "__skein_row"


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns; those that can't be hashed count by their JSON."""
    columns = []
    for name, kind in docs.dtypes:
        c = F.col("`" + name.replace("`", "``") + "`")
        columns += [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c, c.isNull()]
    return F.xxhash64(*columns)


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash h and keys of every row, staged; whole texts are read once."""
    size = F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("bigint")
    keys = [common.id_key().alias(common.ID_KEY), _row_key(docs).alias(ROW_KEY), F.monotonically_increasing_id().alias("row_no")]
    rows = common.staged(docs.select("doc_id", "source", size.alias("size"), hash_bits(F.col("doc_id")).alias("h"), *keys), "sizes")
    several = rows.groupBy(common.ID_KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    several = common.staged(several.select(common.ID_KEY), "repeated_ids")
    if several.isEmpty():
        return rows.drop("row_no")
    again = common.staged(common.running(rows.join(several, common.ID_KEY, "left_semi"), [common.ID_KEY, ROW_KEY, "row_no"], {}), "repeats")
    firsts = common.staged(again.groupBy(common.ID_KEY, ROW_KEY).agg(F.min("rank").alias("first")), "firsts")
    again = again.join(firsts, [common.ID_KEY, ROW_KEY])
    own = hash_bits(F.concat_ws(":", common.ID_KEY, F.col(ROW_KEY).cast("string"), (F.col("rank") - F.col("first")).cast("string")))
    again = again.withColumn("h", own).select(*rows.columns)
    return common.staged(rows.join(several, common.ID_KEY, "left_anti").select(*rows.columns).unionByName(again).drop("row_no"), "sizes")


#: Up to this many sources, their table of a few numbers each is broadcast; beyond it, it is joined by salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 64


def _with_source(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    if n <= BROADCAST_SOURCES:
        sources = F.broadcast(sources.withColumnRenamed("source", "s"))
        return rows.join(sources, rows["source"].eqNullSafe(sources["s"])).drop("s")
    salted = sources.withColumnRenamed("source", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["source"].eqNullSafe(salted["s"]) & (rows["r"] == salted["salt"])).drop("s", "salt", "r")


def rounds(target: Column, size: Column) -> tuple[Column, Column]:
    """How often every row of a source is taken, and the words (fewer than the source has) still needed.

    A target just below a multiple of the size rounds up to that multiple.
    """
    words = F.floor(target + 0.5).cast("bigint")
    some = size > 0
    return F.when(some, F.floor((words - words % size) / size)).otherwise(0).cast("bigint"), F.when(some, words % size).otherwise(words)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies (times the row is taken) and keys of every row; staged."""
    with common.scratch() as keep:
        rows = with_sizes(docs)
        sums = common.staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
        sources = common.staged(targets(sums, weights, most), "sources")
        n = sources.count()
        whole, need = rounds(F.col("target"), F.col("source_size"))
        plan = sources.withColumns({"whole": whole, "need": need})
        cuts = common.staged(thresholds(_with_source(rows, plan.select("source", "source_no", "need"), n).select("source_no", "size", "h", "need")), "cuts")
        plan = plan.join(cuts, "source_no", "left")
        out = _with_source(rows, plan.select("source", "source_size", "target", "whole", "cut"), n)
        copies = F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
        return keep(out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), common.ID_KEY, ROW_KEY), "mix")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, with their columns: a row that is taken k times stands there k times."""
    keys = [common.ID_KEY, ROW_KEY]
    # Rows equal in all columns are one row with the copies of all.
    with common.scratch() as keep:
        taken = keep(mix(docs).where("copies > 0").groupBy(*keys).agg(F.sum("copies").alias("copies")), "taken")
    marked = docs.select(common.id_key().alias(common.ID_KEY), _row_key(docs).alias(ROW_KEY), F.struct("*").alias("row"))
    one = marked.join(taken, keys).dropDuplicates(keys)
    return one.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source
), w AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), c AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS level FROM w
), r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM c
), f AS (
  SELECT CAST(rest AS DOUBLE) AS rest, CAST(heavy AS DOUBLE) AS heavy FROM r WHERE rest <= level * heavy ORDER BY level, no LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT rest FROM f) / (SELECT heavy FROM f)), CAST(cap AS DOUBLE)) AS target FROM r
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE CAST(floor(target + 0.5) AS BIGINT) END AS need FROM t
), g AS (
  SELECT source, h, sum(size) AS words FROM d GROUP BY source, h
), u AS (
  SELECT q.source, h, sum(words) OVER (PARTITION BY q.source ORDER BY h) AS upto, sum(words) OVER (PARTITION BY q.source ORDER BY h) - words AS below, need
  FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source
), cut AS (
  SELECT source, h + CASE WHEN upto - need < need - below THEN 1 ELSE 0 END AS cut FROM u WHERE below <= need AND need < upto
)
SELECT d.doc_id, d.size, q.source_size, q.target, CAST(d.size * (q.whole + CASE WHEN d.h < cut.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""
