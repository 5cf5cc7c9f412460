"""Exact search of the largest inner products by aggregation of sorted lists without random access.

The candidates are cut into shards of ``SHARD`` rows and the queries into groups of ``GROUP``
rows, and a task takes one shard and one group. It goes through the shard in tiles of ``TILE``
rows. A tile has one list for each dimension, sorted by the component; a query reads the list
from the end that contributes most, and ``ASK`` queries read together. After each stretch of
reading, what a row can still reach (the sum so far and, for each list in which it was not met,
the entry read last) and what it has for certain (the sum and the worst entry of those lists)
bound its score. Reading stops once
the rows outside a small set cannot qualify: their upper bound is below the k-th best certain
score of the tile, or below the k-th best score that the query has from earlier tiles. The
scores of that set are then resolved. A tie with the k-th best keeps a row in, so ties are decided
by vec_id alone. The k best of each shard are merged by a ranking that Spark limits before it shuffles.

Nothing is broadcast. A query group is sent to each shard and a shard to each query group;
copies of one vector are spread over shards by row number, and memory is bounded by the three sizes.

Components become ``floor(scale * x)`` of x as double. Rows whose vector is null or holds a null
or a component that is not finite take no part. A vector that is shorter than others is filled
with zeros. Repeated rows are candidates and queries of their own; a row is never a candidate
for itself. A null vec_id is no query and loses all ties. Sums of products are exact in the float type that
is taken; where none is wide enough, a shard is scored in whole numbers of any size without
lists, and a score beyond 64 bits is an error. An empty table has no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import scan
from ..session import cut

SHARD = 1 << 13
TILE = 1 << 11
GROUP = 1 << 16
ASK = 1 << 8  # queries that read the lists of a tile together
STRETCHES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # of a list, each read in one go
SMALL = 128  # a set of so many rows that could qualify is resolved
_LAST = np.iinfo(np.int64).max  # stands for a null vec_id


class Tile:
    """Sorted lists over the rows of a matrix, read to one depth for many queries at a time.

    A weight above zero reads its list from the largest component, one below zero from the least.
    With u the entry read last, a row was met in a list if its component is u or beyond, so the
    sum of what was read and of u for the rest is ``max(component, u)`` times the weight.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.lists = np.sort(matrix, axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Possible and certain contributions of each row for weights above and below zero."""
        x, n = self.matrix, len(self.matrix)
        high, low = self.lists[n - depth], self.lists[depth - 1]
        possible = np.hstack([np.maximum(x, high), np.minimum(x, low)])
        certain = np.hstack([np.where(x >= high, x, self.lists[0]), np.where(x <= low, x, self.lists[-1])])
        return possible, certain

    def best(self, queries: np.ndarray, k: int, floor: np.ndarray, small: int = SMALL) -> list[np.ndarray]:
        """For each query rows among which are all that reach the k best scores of the tile and
        its ``floor``."""
        n = len(self.matrix)
        out = [np.arange(n)] * len(queries)
        if n <= max(k, small):
            return out
        weights = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).T
        reading, depth = np.arange(len(queries)), 0
        for stretch in STRETCHES:
            depth = max(depth + 1, min(n, int(n * stretch)))
            possible, certain = self.bounds(depth)
            sure = np.partition(certain @ weights[:, reading], n - k, axis=0)[n - k]
            may = (possible @ weights[:, reading]).T >= np.maximum(floor[reading], sure)[:, None]
            stop = (may.sum(axis=1) <= small) | (depth == n)
            for q, rows in zip(reading[stop], may[stop]):
                out[q] = np.flatnonzero(rows)
            reading = reading[~stop]
            if not len(reading):
                break
        return out


def _exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    """A type in which every sum of products is a whole number without rounding."""
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


def search_shard(
    ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, tile: int = TILE
) -> list[tuple[int, int, int]]:
    """``(query, row, score)`` of the k best rows for each query; ``asked`` and ``own`` are row
    numbers, by which a row is not its own candidate."""
    scores: list[list[tuple[int, int, int]]] = [[] for _ in asked]
    kind = _exact(vectors, queries)
    if kind is object:
        vectors, queries = (np.array([[int(x) for x in v] for v in m], object).reshape(m.shape) for m in (vectors, queries))
    else:
        vectors, queries = vectors.astype(kind), queries.astype(kind)
    for start in range(0, len(ids), tile):
        part = slice(start, start + tile)
        matrix, mine, names = vectors[part], own[part], ids[part]
        lists = None if kind is object else Tile(matrix)
        for first in range(0, len(asked), ASK):
            some = slice(first, first + ASK)
            if lists is None:
                found = [np.arange(len(matrix))] * len(asked[some])
            else:
                floor = np.array([held[-1][0] if len(held) == k else -np.inf for held in scores[some]])
                # One more than k, as the row itself may be among them.
                found = lists.best(queries[some], k + 1, floor)
            for q, rows in enumerate(found, first):
                rows = rows[mine[rows] != asked[q]]
                if len(rows):
                    best = zip(map(int, matrix[rows] @ queries[q]), [-i for i in names[rows].tolist()], mine[rows].tolist())
                    scores[q] = sorted([*scores[q], *best], reverse=True)[:k]
    return [(int(asked[q]), row, score) for q, held in enumerate(scores) for score, _, row in held]


def search(
    table: DataFrame, vector: str, is_query: Column, k: int, scale: int = 256, shard: int = SHARD, group: int = GROUP
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row with ``is_query``."""
    # NaN is above infinity in Spark.
    good = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    )
    rows = table.filter(good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("_ask"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("_v"),
    )
    rows = cut(scan.number(rows, ["vec_id", "_v", "_ask"], "_row"))
    total, width, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("_v")), F.count_if("_ask")).first()  # three numbers
    shards, groups = max(1, -(-total // shard)), max(1, -(-asked // group))
    asks = cut(scan.number(rows.filter("_ask").drop("_ask"), ["_row"], "_place"))
    mine = rows.select(
        (F.col("_row") % shards).alias("_shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_group"),
        "vec_id", "_row", "_v",
    )
    theirs = asks.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("_shard"),
        F.floor(F.col("_place") / group).alias("_group"),
        "_row", "_v",
    )
    schema = pa.schema([("_ask", pa.int64()), ("_row", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, v in enumerate(column.combine_chunks().to_numpy(zero_copy_only=False)):
            out[i, : len(v)] = v
        return out

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = left["vec_id"].fill_null(_LAST).to_numpy()
        found = search_shard(
            ids, left["_row"].to_numpy(), matrix(left["_v"]), right["_row"].to_numpy(), matrix(right["_v"]), k
        )
        of = dict(zip(left["_row"].to_pylist(), left["vec_id"].to_pylist()))
        rows = [(*f, of[f[1]]) for f in found]
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    keys = ["_shard", "_group"]
    best = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(
        task, "_ask long, _row long, score long, vec_id long"
    )
    order = Window.partitionBy("_ask").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    who = asks.select(F.col("_row").alias("_ask"), F.col("vec_id").alias("query_id"))
    return best.join(who, "_ask").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
