"""Connected components as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import saved


def components(edges: DataFrame) -> DataFrame | None:
    """(node, component): the smallest node reachable over the undirected edges (a, b); None if there are no edges.

    Each pass takes the smallest label next door and that label's own label, so labels travel in growing steps. Every
    pass is written to the shared folder, so its lineage is short and a lost executor costs a reread.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = saved(edges.select(ways).select("way.a", "way.b").distinct())
    if both.isEmpty():
        return None
    labels = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"), F.lit(True).alias("moved")))
    while not labels.filter("moved").isEmpty():
        known = labels.select("node", "component")
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        onward = known.select(F.col("node").alias("near"), F.col("component").alias("onward"))
        found = known.join(near, "node").join(onward, "near", "left")
        best = F.least("component", "near", "onward")
        labels = saved(found.select("node", best.alias("component"), (best != F.col("component")).alias("moved")))
    return labels.select("node", "component")
