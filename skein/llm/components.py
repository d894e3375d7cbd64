"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two aggregations and joins over the edges, staged in the shared folder; neither
edges nor components are ever collected. Minima are staged before the join on them, so that the
planner sees plain scans and can split the partition of a node with very many edges. No join is a
broadcast, which would pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is its component's smallest node.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    with common.scratch() as keep:
        edges = common.staged(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
        seen = _print(edges)
        while seen[0]:
            with common.scratch() as keep_edges:
                edges = keep_edges(_round(edges), "edges")
            now = _print(edges)
            if now == seen:
                break
            seen = now
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "minima")
    # large star: neighbours above u point to u's minimum.
    large = common.staged(common.joined(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    # small star: u and its neighbours below it point to the least of them.
    least = common.staged(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
    below = common.joined(large, least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
