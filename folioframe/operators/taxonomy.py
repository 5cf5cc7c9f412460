"""Taxonomy trees: closure, subtree, names, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scan
from ..session import cut


def closure(items: DataFrame, distances: bool = False) -> DataFrame:
    """``(grp, ancestor, id)`` for every item and each of its ancestors, itself included; with
    ``distances`` also ``dist``, the steps between them.

    ``items`` has ``(grp, id, parent)``. The reach doubles with every round, so a tree of
    depth d takes log2(d) joins.
    """
    nodes = items.select("grp", F.col("id").alias("ancestor"), "id", F.lit(0).alias("dist"))
    step = items.filter(F.col("parent").isNotNull()).select(
        "grp", F.col("parent").alias("ancestor"), "id", F.lit(1).alias("dist")
    )
    reach = cut(step)
    if not reach.filter(F.col("ancestor") == F.col("id")).isEmpty():
        raise ValueError("taxonomy has a cycle")
    frontier = reach
    length = 1
    while True:
        left, right = frontier.alias("l"), reach.alias("r")
        longer = cut(
            left.join(right, (F.col("l.grp") == F.col("r.grp")) & (F.col("l.id") == F.col("r.ancestor"))).select(
                "l.grp", "l.ancestor", "r.id", (F.col("l.dist") + F.col("r.dist")).alias("dist")
            )
        )
        if not longer.filter(F.col("ancestor") == F.col("id")).isEmpty():
            raise ValueError("taxonomy has a cycle")
        if longer.isEmpty():
            every = nodes.unionByName(reach)
            return every if distances else every.select("grp", "ancestor", "id")
        length *= 2
        reach = reach.unionByName(longer)
        frontier = longer.filter(F.col("dist") == length)


def paths(closed: DataFrame) -> DataFrame:
    """``(grp, id, path)``: the ancestors of an item; as long as the tree is deep."""
    return closed.groupBy("grp", "id").agg(F.collect_set("ancestor").alias("path"))


def intervals(items: DataFrame) -> DataFrame:
    """``(grp, id, begin, end)``: places of the items in the order of the tree, children after their
    parent by id; the subtree of an item is the range of places from ``begin`` to ``end``.

    Sizes of subtrees add up along pointers that reach twice as far in every round, and so do the
    places, as a place is the sum of the steps on the way from the root. A tree of depth d takes
    log2(d) rounds each with a row for each item, whatever its shape. Steps need the sizes of the
    siblings before, a running sum that spreads over partitions, so a parent may have any number of children.
    """
    total = items.count()
    nodes = cut(items.select("grp", "id", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")))
    reach = 1
    while not nodes.filter(F.col("up").isNotNull()).isEmpty():
        if reach > total:
            raise ValueError("taxonomy has a cycle")
        below = nodes.filter(F.col("up").isNotNull()).groupBy("grp", F.col("up").alias("id")).agg(F.sum("size").alias("_below"))
        further = nodes.select("grp", F.col("id").alias("up"), F.col("up").alias("_further"))
        nodes = cut(
            nodes.join(below, ["grp", "id"], "left")
            .join(further, ["grp", "up"], "left")
            .select("grp", "id", "parent", F.col("_further").alias("up"), (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size"))
        )
        reach *= 2
    placed = scan.place(nodes.drop("up"), ["grp", "parent", "id"])
    earlier = scan.unplace(scan.run(placed, ["grp", "parent"], {"step": ("sum", F.col("size"))}, inclusive=False))
    # A child comes after its parent and the subtrees of the children before it.
    own = F.when(F.col("parent").isNotNull(), 1).otherwise(0)
    nodes = cut(earlier.select("grp", "id", F.col("parent").alias("up"), "size", (F.coalesce("step", F.lit(0)) + own).alias("begin")))
    while not nodes.filter(F.col("up").isNotNull()).isEmpty():
        further = nodes.select("grp", F.col("id").alias("up"), F.col("up").alias("_further"), F.col("begin").alias("_more"))
        nodes = cut(
            nodes.join(further, ["grp", "up"], "left").select(
                "grp", "id", F.col("_further").alias("up"), "size", (F.col("begin") + F.coalesce("_more", F.lit(0))).alias("begin")
            )
        )
    return nodes.select("grp", "id", "begin", (F.col("begin") + F.col("size") - 1).alias("end"))


def bounds(places: DataFrame, grp: str, item: int) -> tuple[int, int]:
    """First and last place of a subtree, one row; an unknown item has an empty range."""
    row = places.filter((F.col("grp") == grp) & (F.col("id") == item)).select("begin", "end").first()
    return (row.begin, row.end) if row else (0, -1)


def with_places(values: DataFrame, places: DataFrame) -> DataFrame:
    """Adds ``place`` to taxonomy values: stored in its order, a subtree is a range of the files."""
    p = places.select(F.col("grp").alias("_grp"), F.col("id").alias("_id"), F.col("begin").alias("place"))
    return values.join(
        p, (F.col("txo.grp") == F.col("_grp")) & (F.col("txo.id") == F.col("_id")), "left"
    ).drop("_grp", "_id")


def with_paths(values: DataFrame, path_table: DataFrame) -> DataFrame:
    """Adds ``path`` to taxonomy values, for ``in_taxonomy`` tests."""
    p = path_table.select(F.col("grp").alias("_grp"), F.col("id").alias("_id"), "path")
    return values.join(
        p, (F.col("txo.grp") == F.col("_grp")) & (F.col("txo.id") == F.col("_id")), "left"
    ).drop("_grp", "_id")


def resolve(values: DataFrame, items: DataFrame, name: str = "name") -> DataFrame:
    """Adds the ``C`` name of taxonomy values; NULL when the item is unknown."""
    names = items.select(
        F.col("grp").alias("_grp"), F.col("id").alias("_id"),
        F.try_element_at("names", F.lit("C")).alias(name),
    )
    return values.join(
        names, (F.col("txo.grp") == F.col("_grp")) & (F.col("txo.id") == F.col("_id")), "left"
    ).drop("_grp", "_id")


def by_name(rows: DataFrame, items: DataFrame, grp: str, column: str) -> DataFrame:
    """Adds the ``id`` of the item of ``grp`` whose ``C`` name is in ``column``."""
    names = items.filter(F.col("grp") == grp).select(
        F.try_element_at("names", F.lit("C")).alias("_name"), "id"
    )
    return rows.join(names, F.col(column) == F.col("_name"), "left").drop("_name")


def check_names(items: DataFrame) -> DataFrame:
    """``C`` names used by more than one item of a group."""
    named = items.select("grp", F.try_element_at("names", F.lit("C")).alias("name"), "id")
    return named.groupBy("grp", "name").agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1) & F.col("name").isNotNull()
    )


def prune(values: DataFrame, closed: DataFrame) -> DataFrame:
    """Drops a taxonomy value when the same field also holds one of its descendants. The values
    that are left of a field move up, so its positions stay without gaps."""
    strict = closed.filter(F.col("ancestor") != F.col("id"))
    held = values.filter(F.col("type") == "txo").select("key", "attr", "txo.grp", "txo.id").distinct()
    implied = (
        held.join(strict, ["grp", "id"])
        .select("key", "attr", F.col("grp").alias("_grp"), F.col("ancestor").alias("_id"))
        .distinct()
    )
    v, i = values.alias("v"), implied.alias("i")
    same = (
        (F.col("v.key") == F.col("i.key"))
        & (F.col("v.attr") == F.col("i.attr"))
        & (F.col("v.txo.grp") == F.col("i._grp"))
        & (F.col("v.txo.id") == F.col("i._id"))
    )
    left = v.join(i, same, "left_anti")
    fields = cut(v.join(i, same, "left_semi").select("key", "attr").distinct())
    moved = scan.dense(left.join(fields, ["key", "attr"], "left_semi").select(*values.columns), ["key", "attr"])
    return left.join(fields, ["key", "attr"], "left_anti").select(*values.columns).unionByName(moved)
