"""Ordered views: sets of keys ordered by multi-valued fields, addressable by position.

A record sorts by the list of sort keys of all its values: lexicographic, an absent field is
the empty list and comes first, a shorter list comes before its extensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import ROW, sort_key
from ..plans import scan
from ..session import cut

# Values gathered in one row at a time. Longer lists are ranked in levels, see below.
CHUNK = 64


def _chunks(items: DataFrame) -> DataFrame:
    """``(key, pos, part)`` gathered in lists of at most ``CHUNK``: ``(key, pos, parts)``."""
    slots = items.select("key", F.expr(f"pos div {CHUNK}").cast("int").alias("pos"), F.struct("pos", "part").alias("_p"))
    lists = slots.groupBy("key", "pos").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    return lists.select("key", "pos", F.col("_ps.part").alias("parts"))


def list_keys(values: DataFrame, field: str) -> DataFrame:
    """``(key, parts)``: an array of at most ``CHUNK`` parts per record that orders records as
    their whole lists do.

    A long list is cut into chunks, and every chunk replaced by its rank among all chunks.
    Ranks of chunks compare as the chunks do, so the list of ranks orders as the list did and
    is ``CHUNK`` times shorter. A record with n values takes log(n) levels, and no row ever
    holds more than ``CHUNK`` values.
    """
    items = values.filter(F.col("attr") == field).select("key", "pos", sort_key(ROW).alias("part"))
    while True:
        longest = items.agg(F.max("pos").alias("m")).first().m
        if longest is None or longest < CHUNK:
            return _chunks(items).select("key", "parts")
        # Chunks must start at the same value in every list, so positions may not have gaps.
        items = scan.dense(items, ["key"])
        chunks = cut(_chunks(items))
        ranks = scan.number(chunks.select("parts").distinct(), ["parts"], "part")
        items = cut(chunks.join(ranks, "parts").select("key", "pos", "part"))


def order_columns(values: DataFrame, keys: DataFrame, by: Sequence[tuple[str, bool]]):
    """Keys with one list column per criterion, and the columns to order by.

    ``by`` lists (field, ascending). The last column is always the key: ties keep key order.
    """
    rows = keys.select("key").distinct()
    order = []
    for i, (field, ascending) in enumerate(by):
        lists = list_keys(values, field).withColumnRenamed("parts", f"_o{i}")
        rows = rows.join(lists, "key", "left")
        # NULL would sort apart from the empty list, so absent becomes empty.
        rows = rows.withColumn(f"_o{i}", F.coalesce(f"_o{i}", _empty_like(lists, f"_o{i}")))
        order.append(F.col(f"_o{i}").asc() if ascending else F.col(f"_o{i}").desc())
    return rows, [*order, F.col("key").asc()]


def _empty_like(lists: DataFrame, column: str) -> Column:
    return F.array().cast(lists.schema[column].dataType)


def view(values: DataFrame, keys: DataFrame, by: Sequence[tuple[str, bool]]) -> DataFrame:
    """``(key, pos)`` with the position from 0, over any number of records."""
    rows, order = order_columns(values, keys, by)
    return scan.number(rows, order).select("key", "pos")


def first(values: DataFrame, keys: DataFrame, by: Sequence[tuple[str, bool]], n: int, skip: int = 0) -> DataFrame:
    """A page of the view, without numbering the rest: Spark takes the top of each partition."""
    rows, order = order_columns(values, keys, by)
    return rows.orderBy(*order).offset(skip).limit(n).select("key")


def _before(left: Sequence[Column], right: Sequence[Column], by: Sequence[tuple[str, bool]]) -> Column:
    """Whether one row comes before another; both by the lists of ``by`` and then the key."""
    out = left[-1] < right[-1]
    for a, b, (_, ascending) in reversed(list(zip(left, right, by))):
        out = ((a < b) if ascending else (a > b)) | ((a == b) & out)
    return out


def _literal(value, kind) -> Column:
    return F.array(*[F.lit(x) for x in value]).cast(kind) if isinstance(value, list) else F.lit(value).cast(kind)


def select(
    values: DataFrame, keys: DataFrame, by: Sequence[tuple[str, bool]], position: int, n: int = 1, pieces: int = 16
) -> DataFrame:
    """``(key, pos)`` of ``n`` rows from a position on, by selection: a sample gives borders of ranges, one
    pass counts the rows of each range without a shuffle of rows, and only the ranges that hold the
    positions are sorted. The driver gets a sample of bounded size and a count for each range.
    """
    rows, order = order_columns(values, keys, by)
    rows = cut(rows)
    columns = [*[f"_o{i}" for i in range(len(by))], "key"]
    total = rows.count()
    sample = rows.sample(min(1.0, 20 * pieces / max(total, 1)), seed=1).orderBy(*order).limit(100 * pieces).collect()
    borders = sample[:: max(1, -(-len(sample) // pieces))][1:]
    own = [F.col(c) for c in columns]
    number = F.lit(0)
    for border in borders:
        other = [_literal(border[c], rows.schema[c].dataType) for c in columns]
        number = number + F.when(_before(own, other, by), 0).otherwise(1)
    ranged = rows.withColumn("_range", number)
    sizes = {r._range: r.n for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, first, skipped = [], 0, 0
    for piece in range(len(borders) + 1):
        size = sizes.get(piece, 0)
        if first + size <= position:
            skipped = first + size
        elif first < position + n:
            wanted.append(piece)
        first += size
    page = ranged.filter(F.col("_range").isin(wanted)) if wanted else ranged.limit(0)
    page = page.orderBy(*order).offset(position - min(skipped, position)).limit(n).select("key", *columns[:-1])
    # A page of n rows: numbering them needs no spreading.
    place = F.row_number().over(Window.orderBy(*order)) + F.lit(position - 1)
    return page.select("key", place.cast("bigint").alias("pos"))


def position_of(values: DataFrame, keys: DataFrame, by: Sequence[tuple[str, bool]], key: int) -> DataFrame:
    """``(key, pos)`` of one key, by a count of the rows before it; no row if it is not in the view."""
    rows, _ = order_columns(values, keys, by)
    rows = cut(rows)
    columns = [*[f"_o{i}" for i in range(len(by))], "key"]
    here = rows.filter(F.col("key") == key).first()
    if here is None:
        return rows.limit(0).select("key", F.lit(0).cast("bigint").alias("pos"))
    other = [_literal(here[c], rows.schema[c].dataType) for c in columns]
    before = _before([F.col(c) for c in columns], other, by)
    return rows.agg(F.count_if(before).alias("pos")).select(F.lit(key).cast("bigint").alias("key"), "pos")


def at(ordered: DataFrame, position: int, n: int = 1) -> DataFrame:
    return ordered.filter((F.col("pos") >= position) & (F.col("pos") < position + n))


def index_of(ordered: DataFrame, keys: DataFrame) -> DataFrame:
    """Positions of the given keys; NULL for those not in the view."""
    return keys.select("key").distinct().join(ordered, "key", "left").select("key", "pos")


def nested_order(field: str) -> Column:
    """The same order for nested records, whose values already share a row."""
    lists = F.transform(F.try_element_at("attrs", F.lit(field)), sort_key)
    return F.coalesce(lists, F.array().cast("array<string>"))
