"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between different nodes; ``root`` is the smallest node reachable.

    Every round points neighbours at the smallest node known, with a partial minimum before each shuffle, so
    that a node with very many edges meets no single task as a group; the number of rounds grows with the
    logarithm of the longest chain. Rounds are written tables. Equal edges and loops do no harm.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = written(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(now: DataFrame) -> bool:
    """Every node points at one other, which points nowhere: nothing is left to do."""
    sides = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        now.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = sides.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.agg(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).head()[0]
