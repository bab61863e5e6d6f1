"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (a, b), the smallest node that links reach from it.

    Every round each node hooks to its smallest neighbour, chains of hooks are followed to their
    ends by doubling, and the edges are drawn anew between the ends. The nodes that still have
    edges at least halve in a round. All of it is aggregation and equi-joins; each round's tables
    are stored, so that lost executors don't repeat earlier rounds. Only counts reach the driver.
    """
    links = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    names = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = materialize(up.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        names = up if names is None else materialize(
            names.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        )
        # after the hooks an edge joins two ends or lies within one
        a = up.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = materialize(links.join(a, "a").join(b, "b").where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if links.isEmpty():
            return names.select("node", F.col("root").alias("component"))
