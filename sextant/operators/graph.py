"""Connected components of links between nodes named by longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch, stored


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of links (u, v).

    Alternates large stars (every neighbour above a node is linked to the node's smallest
    neighbour) and small stars (those below it) until each component is one star. A hub
    is a partial aggregate and one side of a join, never a collected group. Each round
    ends in a stored table; the result is one.
    """
    with scratch(links.sparkSession):
        edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges, before = stored(edges), None
        while True:
            state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if state == before or not state.n:
                break
            before = state
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u")
            edges = stored(
                small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            )
        nodes = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        every = nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return stored(every.groupBy("node").agg(F.min("root").alias("root")), keep=True)
