"""Connected components of an edge table by alternating large and small stars, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node hangs on the smallest in the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("c")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, hang on the smallest of them. Edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
    joined = edges.join(least, F.col("a") == F.col("c")).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node of `edges` (a, b: long, a != b); a component's smallest node is its root, and has a row too."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        now = cut(_small_star(_large_star(now)))
        tidy(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root of `found` (of components) with more `edges` (a, b: long): only the components that these link are looked at again."""
    if edges.isEmpty():
        return found
    roots = lambda k: found.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    lifted = edges.join(roots("a"), "a", "left").join(roots("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b")
    merged = cut(components(lifted))
    moved = merged.select(F.col("node").alias("was"), F.col("root").alias("now"))
    old = found.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    return old.unionByName(merged.join(found.select("node"), "node", "left_anti"))
