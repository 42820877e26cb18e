"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and joins; nothing is collected, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, staged_so_far


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: columns u, v (long; other columns are ignored). Returns node, root (the smallest node reachable), for nodes that have a link to another.

    Null ends, loops and repeated links have no effect. Raises RuntimeError if it has not settled after most_rounds
    (a path of n nodes takes about 2 log2 n).
    """
    spark, tables = links.sparkSession, staged_so_far()
    edges = staged(_tidy(links.select("u", "v").filter("u is not null and v is not null")), "links")
    before = None
    for _ in range(most_rounds):
        edges = staged(_tidy(_small(_tidy(_large(edges)))), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(spark, tables, but_last=1)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("components have not settled")
