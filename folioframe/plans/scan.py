"""Ordered computations without an unbounded window.

``row_number()`` over one big group runs in one task. Here the rows are range-partitioned
on their order instead, every partition is computed on its own, and the state at each
partition border (one row per partition) is carried over. A group that holds a third of all
rows is therefore spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# monotonically_increasing_id() is partition number * 2^33 + row number in the partition.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1
_HELPERS = ("_at", "_part")

Order = Sequence[str | Column]


def place(df: DataFrame, order: Order) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with their place frozen in ``_at``.

    The order must be total. The result is written to the shared folder: sampled partition
    borders differ from run to run, and the later passes have to agree on them.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", _ROW_BITS)
    )


def unplace(df: DataFrame) -> DataFrame:
    return df.drop(*_HELPERS)


def number(df: DataFrame, order: Order, name: str = "pos") -> DataFrame:
    """Global position from 0 under a total order."""
    rows = place(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: this window and the broadcast are bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit(_ROW_MASK))
    )
    return unplace(numbered.drop("_offset"))


def _total(fn: str, value: Column) -> Column:
    if fn == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col("_at")))
    return {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}[fn](value)


def _over(fn: str, value: Column, window) -> Column:
    if fn == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}[fn](value).over(window)


def _combine(fn: str, carried: Column, here: Column) -> Column:
    if fn in ("count", "sum"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
    if fn == "max":
        return F.greatest(carried, here)
    if fn == "min":
        return F.least(carried, here)
    return F.coalesce(here, carried)


def run(
    rows: DataFrame,
    group: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates inside ``group``, over rows made by ``place``.

    ``group`` must be a prefix of the order the rows were placed by. ``outputs`` maps a new
    column to (count | sum | max | min | last, value); ``last`` is the last non-null value.
    """
    group = list(group)
    here = (
        Window.partitionBy("_part", *group)
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    totals = rows.groupBy("_part", *group).agg(
        *[_total(fn, value).alias(f"_t_{name}") for name, (fn, value) in outputs.items()],
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
    )
    # Only the group at the start and the one at the end of a partition can cross a border.
    ends = rows.groupBy("_part").agg(F.max("_at").alias("_end"))
    border = totals.join(F.broadcast(ends), "_part").filter(
        (F.col("_first").bitwiseAND(F.lit(_ROW_MASK)) == 0) | (F.col("_last") == F.col("_end"))
    )
    before = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )

    def carried(fn: str, name: str) -> Column:
        total = F.col(f"_t_{name}")
        if fn == "last":
            return F.last(total, ignorenulls=True).over(before)
        return {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[fn](total).over(before)

    carries = border.select(
        F.col("_part").alias("_border"),
        *[F.col(g).alias(f"_c_{i}") for i, g in enumerate(group)],
        *[carried(fn, name).alias(f"_c_{name}") for name, (fn, _) in outputs.items()],
        F.count(F.lit(1)).over(before).alias("_earlier"),
    ).filter(F.col("_earlier") > 0)
    local = rows.select(
        "*", *[_over(fn, value, here).alias(f"_l_{name}") for name, (fn, value) in outputs.items()]
    )
    same = F.col("_part") == F.col("_border")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_c_{i}"))
    # At most one group per partition continues from the one before: bounded broadcast.
    joined = local.join(F.broadcast(carries), same, "left")
    return joined.select(
        *rows.columns,
        *[
            _combine(fn, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
            for name, (fn, _) in outputs.items()
        ],
    )


def dense(df: DataFrame, group: Sequence[str], position: str = "pos") -> DataFrame:
    """``position`` counted anew from 0 inside ``group``, in the same order."""
    order = [*group, position]
    ranked = unplace(run(place(df, order), group, {"_rank": ("count", F.lit(1))}))
    return ranked.withColumn(position, (F.col("_rank") - 1).cast(df.schema[position].dataType)).select(*df.columns)


def rank(df: DataFrame, group: Sequence[str], order: Order, name: str = "rank") -> DataFrame:
    """Rank from 1 inside ``group`` under a total order; groups may be of any size."""
    rows = place(df, [*group, *order])
    return unplace(run(rows, group, {name: ("count", F.lit(1))}))
