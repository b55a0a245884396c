"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and an equi-join over edge tables; nothing is
collected. A hub's edges are joined against a written table, so that adaptive
execution may split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailrank.llm._store import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edge table (u, v): label is the least node reachable.

    Loops and repeated edges are allowed; rows with a null end are ignored. An
    empty edge table gives an empty result.
    """
    edges = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top")), "low")
        if low.where("m < u AND top <> m").isEmpty():  # only stars around their least nodes are left
            return low.select(F.col("u").alias("node"), F.col("m").alias("label"))
        large = both.where("v > u").join(low.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(hung.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        drop(low, edges)
        edges = after
