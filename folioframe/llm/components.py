"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _roots(tree: DataFrame) -> DataFrame:
    """``node, component``: the end of the way from each node by ``component``, which no way leaves.

    Ways shrink by doubling.
    """
    while True:
        jump = tree.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = cut(tree.join(jump, "component").select("node", F.col("component").alias("before"), F.col("further").alias("component")))
        tree = after.select("node", "component")
        if after.filter(F.col("before") != F.col("component")).isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its least node.

    Each round lets every node point to its least neighbour, follows these ways to their ends, and
    goes on with the links between the ends alone, each once. An end is below all its neighbours; it
    either has nodes that point to it, or a lower end beside it in the next round. So of what is not done
    half of the nodes go in two rounds at least, with their links. Links and labels stay in tables; only
    a test for rows comes back. Minima are combined before each shuffle, and a component or node with a
    large share of the rows is a skewed join, which adaptive execution splits.
    """
    left = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = cut(left.filter(F.col("a") < F.col("b")).distinct())
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        ends = _roots(cut(least.select("node", F.least("node", "least").alias("component"))))
        if labels is None:
            labels = ends
        else:
            further = ends.select(F.col("node").alias("component"), F.col("component").alias("further"))
            further = labels.join(further, "component", "left")
            labels = cut(further.select("node", F.coalesce("further", "component").alias("component")))
        a, b = (ends.select(F.col("node").alias(n), F.col("component").alias(f"end_{n}")) for n in ("a", "b"))
        met = left.join(a, "a").join(b, "b").filter(F.col("end_a") != F.col("end_b"))
        left = cut(met.select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct())
        if left.isEmpty():
            return labels
