"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.storage import metered


def components(edges: DataFrame) -> DataFrame:
    """node, root: the nodes of edges (a, b; longs) that have an edge to another node, each with the smallest node that it is
    connected to.

    Rounds of two star steps: each node's larger neighbours are tied to the smallest of all its neighbours, then its smaller
    neighbours and itself to the smallest of these. Edges never grow in number and a chain is halved, so that the rounds grow with
    the logarithm of the longest chain; each is written out. Both steps are a minimum by node, reduced before its shuffle, and a join.
    """
    mark = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = metered(e, "components", **mark)
    while seen.get("n"):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = metered(tied.unionByName(least.withColumnRenamed("m", "v")).distinct(), "components", **mark)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
