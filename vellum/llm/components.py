"""Connected components on a table of links, without gathering any of them on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, root) with root < node, by pointer jumping."""
    parents = cut_lineage(parents)
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = cut_lineage(parents.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        parents = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that isn't its component's smallest.

    Every node hooks to its smallest lesser neighbour, the trees contract, and links between
    different trees go into the next round; each round at least halves what is left to merge.
    """
    left = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high > low")
    found = None
    while True:
        trees = _roots(left.groupBy("high").agg(F.min("low").alias("low")).select(F.col("high").alias("node"), F.col("low").alias("root")))
        if found is None:
            found = trees
        else:
            onward = trees.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = cut_lineage(found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(trees))
        ends = left
        for end in ("high", "low"):
            ends = ends.join(trees.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        left = cut_lineage(ends.filter("high != low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct())
        if left.isEmpty():
            return found
