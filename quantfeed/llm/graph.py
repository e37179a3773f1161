"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp) for every node of the edges (a, b); comp is the smallest node reachable.

    Each round lets every root adopt its smallest neighbour, shortens the adoption chains by doubling
    and rewrites the edges between the remaining roots, so rounds grow with the logarithm of a
    component's diameter. No edges: no rows. Self-loops and repeated edges change nothing.
    """
    live = durable(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null").distinct())
    labels = live.select(F.col("u").alias("node")).union(live.select("v")).distinct().withColumn("comp", F.col("node"))
    live = live.filter("u <> v")
    while not live.isEmpty():
        both = live.union(live.select("v", "u").toDF("u", "v"))
        hooks = durable(both.groupBy("u").agg(F.min("v").alias("p")).filter("p < u"))
        while True:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            step = durable(hooks.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            hooks = step.select("u", "p")
            if step.filter("moved").isEmpty():
                break
        root = hooks.select(F.col("u").alias("comp"), "p")
        labels = durable(labels.join(root, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        for side in ("u", "v"):
            moved = hooks.select(F.col("u").alias(side), F.col("p").alias("to"))
            live = live.join(moved, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        live = durable(live.select("u", "v").filter("u <> v").distinct())
    return labels
