"""Near duplicates of a chosen similarity, by wide SimHash fingerprints.

Two fingerprint bits of a pair with cosine c differ with probability arccos(c) / pi, and shingle
sets of Jaccard similarity J have c = 2J / (1 + J). A pair of J = 0.8 differs in 39 of 256 bits,
give or take 6. Pairs of at most ``RADIUS`` bits are candidates; they are near duplicates if their
shingle sets, compared whole, have a similarity of ``SIMILAR`` or more. Fingerprints are of the
different shingles, as the sets are. Only texts of one shingle set are one to begin with.

At such distances no block of bits is sure to agree, so shards are drawn by chance: in each of
``TABLES`` tables, documents that agree on ``SAMPLE`` bits of the table's own order share a
shard. A pair at the limit meets in one of them with a probability of 0.998 (0.98 if it differs
in one deviation more), closer pairs almost surely. Chance company in a shard is one document for
each 2 ** ``SAMPLE`` documents; larger corpora want more bits and tables.

A shard is searched by its BK-tree over half of the fingerprint bits, as in ``simhash``. It gives
each document its nearest candidate of another part, and only links whose sets have been compared
join parts. The first ``EARLY`` tables come first, so that the others find parts. Of a shard larger
than ``SHARD`` only pieces of that size are searched, which joins most of a group of close copies.

What is still in several parts of shards that have more candidates is compared whole: chains of
candidates give the families, a family is dealt in cells of two pieces over several tasks, and a
cell compares the sets of its candidates of different parts, those that share a key in any table. It
returns only links that join, so a pair that fails makes no row and hides no other, and the size of a
shard changes no chance to meet. The later tables then only look for pairs of different families.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import batch, give_back, mixed, spread, texts
from .components import components
from .simhash import BKTree, Parts, majority_bits, shingle_hashes

WORDS, BITS, SIMILAR = 5, 256, 0.8
RADIUS, NEAR = 56, 36  # differing bits of all; of the first half, in a shard
TABLES, EARLY, SAMPLE, SHARD = 128, 16, 18, 1024
LARGEST = 1 << 62  # cells are not cut again
WEIGHT = 1 << 9  # shingles that weigh as much as one text in a cell
_SEEDS = [0, 0x51ED270B1F9A3C4D, 0x2B7E151628AED2A6, 0x6A09E667F3BCC909]
_WHOLE = ["f0", "f1", "f2", "f3"]
_HALF = _WHOLE[:2]
_SET = ["s0", "s1"]

Sets = Callable[[DataFrame], DataFrame]  # from ``node`` to ``node, shingles``


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.frombuffer(shingle_hashes(raw, words), ">u8").astype(np.uint64))


def fingerprint(first: np.ndarray) -> np.ndarray:
    """Majority bits of a shingle set under four hash families, 64 each; zeros without shingles."""
    if not len(first):
        return np.zeros(4, np.int64)
    families = [first.astype(">u8") if not seed else mixed(first ^ np.uint64(seed)) for seed in _SEEDS]
    bits = np.concatenate([majority_bits(h.view(np.uint8).reshape(-1, 8)) for h in families])
    return np.packbits(bits).view(np.int64)


@lru_cache(maxsize=2)
def _orders(bits: int) -> np.ndarray:
    """For each table its own order of the bits."""
    draw = np.random.Generator(np.random.PCG64(bits))
    return np.stack([draw.permutation(bits) for _ in range(TABLES)])


def _bits(columns: list[np.ndarray]) -> np.ndarray:
    return np.unpackbits(np.stack(columns, axis=1).view(np.uint8), axis=1)


def _keys(columns: list[np.ndarray], first: int, last: int) -> np.ndarray:
    """The sampled bits of each fingerprint in each of the tables, as numbers."""
    weights = 1 << np.arange(SAMPLE, dtype=np.int32)
    bits = _bits(columns).astype(np.int32)
    return np.stack([bits[:, order[:SAMPLE]] @ weights for order in _orders(BITS)[first:last]], axis=1)


def _numbers(rows: pa.RecordBatch | pa.Table, names: list[str]) -> list[np.ndarray]:
    return [rows[n].to_numpy(zero_copy_only=False) for n in names]


def marks(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, _row``, the fingerprint of every row and a digest of its shingle set; ``rows`` has
    doc_id, text, _row."""
    names = ["doc_id", "_row", *_WHOLE, *_SET]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            found = np.zeros((own.num_rows, 6), np.int64)
            for i, t in enumerate(own["text"].cast(pa.large_binary())):
                shingles = shingle_set(t.as_buffer().to_pybytes(), words)
                found[i, :4] = fingerprint(shingles)
                found[i, 4:] = np.frombuffer(xxhash.xxh128_digest(shingles.tobytes()), np.int64)
            yield batch(schema, own["doc_id"], own["_row"], *found.T)
        give_back()

    return texts(rows, "_row").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _dealt(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Every node once in each table: ``table, key, node``, its group and half of its fingerprint."""
    names = ["node", "part", *_HALF, "keys"]
    schema = pa.schema([*((n, pa.int64()) for n in names[:-1]), ("keys", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for at in range(0, own.num_rows, 2000):
                part = own.slice(at, 2000)
                keys = _keys(_numbers(part, _WHOLE), first, last)
                ends = np.arange(len(keys) + 1, dtype=np.int32) * (last - first)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield batch(schema, *(part[n] for n in names[:-1]), lists)

    keyed = nodes.select("node", "part", *_WHOLE).mapInArrow(run, "node long, part long, f0 long, f1 long, keys array<int>")
    dealt = keyed.select(F.posexplode("keys").alias("table", "key"), "node", "part", *_HALF)
    return dealt.withColumns({"table": F.col("table") + first, "key": F.col("key").cast("long")})


def near_pairs(
    fps: list[int], part: list[int], side: list[int], radius: int, most: int
) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of places within the radius whose parts differ, for each place its ``most`` nearest,
    and whether any place has more. With two sides, only pairs of one and the other."""
    tree, out, more = BKTree(), [], False
    placed, asked = [], range(len(fps))
    if len(set(side)) > 1:
        placed, asked = sorted(([j for j in asked if (side[j] == side[0]) == own] for own in (True, False)), key=len, reverse=True)
        for j in placed:
            tree.add(fps[j])
    for j in asked:
        near = [placed[i] if placed else i for i in tree.near(fps[j], radius)]
        near = [i for i in near if part[i] != part[j]]
        if len(near) > most:
            more = True
            near = nsmallest(most, near, key=lambda i: (fps[j] ^ fps[i]).bit_count())
        out += [(i, j) for i in near]
        if not placed:
            tree.add(fps[j])
    return out, more


def _searched(rows: DataFrame, most: int, size: int) -> DataFrame:
    """Pairs ``a, b`` of nodes in a shard, and the rows of the shards that have more pairs.

    A shard of more than ``size`` rows has only pieces of that size searched, as it comes.
    """
    names = ["table", "key", "cell", "node", "part", "side", *_HALF]
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", *names)])

    def linked(rows: np.ndarray) -> tuple[list[tuple], bool]:
        node, part, side = rows[3:6].tolist()
        if len(set(part)) == 1:
            return [], False
        halves = rows[6:].astype(np.uint64).tolist()
        found, more = near_pairs([x << 64 | y for x, y in zip(*halves)], part, side, NEAR, most)
        return [(node[i], node[j]) for i, j in found], more

    def give(pieces: list[tuple[np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []
        for rows, large in pieces:
            found, more = linked(rows)
            links += found
            if more or large:
                none = [None] * rows.shape[1]
                yield batch(schema, none, none, *rows)
        if links:
            none = [None] * len(links)
            yield batch(schema, *zip(*links), *[none] * len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), 0), np.int64)  # the shard that may go on in the next batch
        large = None  # the shard that was found too large
        for own in batches:
            new = np.stack([x.astype(np.int64) for x in _numbers(own, names)])
            new = np.ascontiguousarray(np.concatenate([held, new], axis=1))
            border = [0, *(np.flatnonzero(np.any(new[:3, 1:] != new[:3, :-1], axis=0)) + 1), new.shape[1]]
            pieces, held = [], new[:, new.shape[1] :]
            for s, e in zip(border, border[1:]):
                name = tuple(new[:3, s].tolist()) if e > s else None
                if e > s and (name == large or e - s > size):
                    large = name
                    pieces += [(np.ascontiguousarray(new[:, i : min(i + size, e)]), True) for i in range(s, e, size)]
                elif e == new.shape[1]:
                    held = new[:, s:]  # it may go on in the next batch
                elif e - s > 1:
                    pieces.append((np.ascontiguousarray(new[:, s:e]), False))
            yield from give(pieces)
        if held.shape[1] > 1:
            yield from give([(np.ascontiguousarray(held), False)])
        give_back()

    placed = rows.repartition("table", "key", "cell").sortWithinPartitions("table", "key", "cell")
    return placed.select(*names).mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def _cells(rows: DataFrame, size: int, weight: Column | None = None) -> DataFrame:
    """The rows of the shards of several parts in cells, so that each two rows of different parts
    meet in one: chunks against chunks, those of the largest part not against each other."""
    weight = F.lit(1) if weight is None else weight
    sizes = rows.groupBy("table", "key", "part").agg(F.sum(weight).alias("n"))
    sizes = sizes.groupBy("table", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("big"))
    sizes = sizes.filter(F.col("big.n") < F.col("n")).select(
        "table",
        "key",
        F.col("big.part").alias("big"),
        F.ceil((F.col("n") - F.col("big.n")) / size).alias("small_chunks"),
        F.ceil(F.col("big.n") / size).alias("big_chunks"),
    )
    own, few, many = F.col("part") == F.col("big"), F.col("small_chunks"), F.col("big_chunks")
    code = F.xxhash64("node", F.lit(1))
    side = F.when(own, few + F.pmod(code, many)).otherwise(F.pmod(code, few))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(own, few).otherwise(few + many) - 1))
    met = rows.join(sizes, ["table", "key"]).withColumn("side", side).withColumn("other", other)
    cell = F.least("side", "other") * (few + many) + F.greatest("side", "other")
    return met.withColumn("cell", cell).drop("big", "small_chunks", "big_chunks", "other")


def _mixed(rows: DataFrame) -> DataFrame:
    """The shards of several parts."""
    ends = rows.groupBy("table", "key").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    return ends.filter("least < most").select("table", "key")


def _stars(parts: DataFrame) -> DataFrame:
    """One link for each node, which join the same nodes as all that are kept."""
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _parted(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the parts of their nodes."""
    placed = rows.drop("part").join(parts, "node", "left")
    return placed.withColumn("part", F.coalesce("component", "node")).drop("component")


def families(halves: np.ndarray, radius: int) -> np.ndarray:
    """For each place the first place of those that chains of places within the radius join to it; two
    numbers for each place."""
    first, root, todo, left = np.arange(len(halves)), 0, [0], np.arange(1, len(halves))
    while len(left):
        if not todo:
            root, left = int(left[0]), left[1:]
            todo = [root]
        i = todo.pop()
        near = np.bitwise_count(halves[left] ^ halves[i]).sum(axis=1) <= radius
        first[left[near]] = root
        todo, left = todo + left[near].tolist(), left[~near]
    return first


def family_links(node: np.ndarray, part: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Links that join the nodes of each family of several parts: a node and its part, a part and the
    least one. Tables that see the same parts give the same links."""
    _, at = np.unique(first, return_inverse=True)
    least, most = np.full(at.max() + 1, part.max()), np.full(at.max() + 1, part.min())
    np.minimum.at(least, at, part)
    np.maximum.at(most, at, part)
    several = (least < most)[at]
    links = np.concatenate([np.stack([node, part], axis=1)[several], np.stack([part, least[at]], axis=1)[several]])
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _chained(cells: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the candidates of different parts of each cell, their sets not compared."""
    names = ["table", "key", "cell", "node", "part", *_HALF]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(rows: np.ndarray) -> np.ndarray:
        if len(np.unique(rows[4])) < 2:
            return np.zeros((0, 2), np.int64)
        return family_links(rows[3], rows[4], families(np.ascontiguousarray(rows[5:].T).view(np.uint64), NEAR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), 0), np.int64)  # the cell that may go on in the next batch
        for own in batches:
            new = np.concatenate([held, np.stack(_numbers(own, names)).astype(np.int64)], axis=1)
            border = np.flatnonzero(np.any(new[:3, 1:] != new[:3, :-1], axis=0)) + 1
            *whole, held = np.split(new, border, axis=1)
            found = np.concatenate([np.zeros((0, 2), np.int64), *map(of, whole)])
            yield batch(schema, *np.unique(found, axis=0).T)
        yield batch(schema, *of(held).T)
        give_back()

    placed = cells.repartition("table", "key", "cell").sortWithinPartitions("table", "key", "cell")
    return placed.select(*names).mapInArrow(run, "a long, b long").distinct()


class Overlaps:
    """How many shingles a set has in common with each of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        n = [len(s) for s in sets]
        self.sizes, self._at = np.array(n), np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        _, self._ids, self._count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self._first = np.cumsum(self._count) - self._count
        self._owner = np.repeat(np.arange(len(sets)), n)[np.argsort(self._ids, kind="stable")]

    def of(self, i: int) -> np.ndarray:
        own = self._ids[self._at[i] : self._at[i + 1]]
        return np.bincount(self._owner[spread(self._first[own], self._count[own])], minlength=len(self.sizes))


def similar_links(
    whole: np.ndarray, keys: np.ndarray, part: list[int], side: np.ndarray, sets: list[np.ndarray] | None, similar: float
) -> list[tuple[int, int]]:
    """Pairs of places that join all similar candidates of different parts that share a key; with two
    sides, only pairs of one and the other. Without sets all candidates are similar."""
    parts, out = Parts(len(part)), []
    own, two = np.array(part), len(np.unique(side)) > 1
    overlaps = None if sets is None else Overlaps(sets)
    for i in range(len(part) - 1):
        bits = np.bitwise_count(whole[i + 1 :] ^ whole[i])
        near = (bits[:, : len(_HALF)].sum(axis=1) <= NEAR) & (bits.sum(axis=1) <= RADIUS) & (own[i + 1 :] != own[i])
        if two:
            near &= side[i + 1 :] != side[i]
        j = np.flatnonzero(near) + i + 1
        j = j[(keys[j] == keys[i]).any(axis=1)]
        if len(j) and overlaps is not None:
            both = overlaps.of(i)[j]
            j = j[both >= similar * (overlaps.sizes[i] + overlaps.sizes[j] - both)]
        out += [(i, k) for k in j.tolist() if parts.join(i, k)]
    return out


def _compared(cells: DataFrame, tables: int, similar: float) -> DataFrame:
    """Links ``a, b`` that join the similar candidates of each cell; ``shingles`` is null where none are compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(own: pa.Table) -> pa.Table:
        node, part, side = _numbers(own, ["node", "part", "side"])
        columns = _numbers(own, _WHOLE)
        raw = own["shingles"]
        sets = None if raw.null_count else [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        whole = np.stack(columns, axis=1).view(np.uint64)
        found = similar_links(whole, _keys(columns, 0, tables), part.tolist(), side, sets, similar)
        at = np.array(found, np.int64).reshape(-1, 2)
        give_back()
        return pa.Table.from_batches([batch(schema, node[at[:, 0]], node[at[:, 1]])])

    names = ["key", "cell", "node", "part", "side", *_WHOLE, "shingles"]
    return cells.select(*names).groupBy("key", "cell").applyInArrow(run, "a long, b long")


def joined(
    nodes: DataFrame, shard: int = SHARD, sets: Sets | None = None, similar: float = SIMILAR
) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of similar nodes, enough to join all nodes that such links join, and ``node,
    component`` of the nodes they join; ``nodes``: node, f0 to f3. ``sets`` gives the shingle sets of
    some nodes; all candidates are similar if it is left out."""
    spark = nodes.sparkSession
    kept, parts = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, component long")
    a, b = (nodes.select(F.col("node").alias(n), *[F.col(f).alias(f"{n}_{f}") for f in _WHOLE]) for n in ("a", "b"))
    bits = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in _WHOLE), F.lit(0))
    zero = F.lit(0).cast("long")
    done = None  # the families of which all pairs have been compared
    for first, last in ((0, EARLY), (EARLY, TABLES)):
        rows = _dealt(_parted(nodes, parts if done is None else done), first, last)
        searched = cut(_searched(rows.withColumns({"cell": zero, "side": zero}), 1, shard))
        pairs = searched.filter("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = cut(pairs.distinct().join(a, "a").join(b, "b").filter(bits <= RADIUS).select("a", "b"))
        if not found.isEmpty():
            tested = found if sets is None else cut(_similar(found, sets, similar))
            kept, parts = kept.union(tested), components(_stars(parts).union(tested))
        own = parts if done is None else done
        left = searched.filter("a IS NULL").select("table", "key", "node", *_HALF).distinct()
        chained = cut(_chained(_cells(cut(_parted(left, own)), shard)))
        if chained.isEmpty():
            done = own
            continue
        # Parts are whole in a family, so what is kept later on joins no two families.
        done = components(chained.union(_stars(parts)))
        family = cut(_parted(done.select(zero.alias("table"), F.col("component").alias("key"), "node"), own))
        family = family.join(_mixed(family), ["table", "key"], "left_semi")
        weight = F.lit(1)
        more = nodes.select("node", *_WHOLE).join(family.select("node"), "node", "left_semi")
        if sets is None:
            more = more.withColumn("shingles", F.lit(None).cast("binary"))
        else:
            more = cut(more.join(sets(family.select("node")), "node"))
            family = family.join(more.select("node", F.octet_length("shingles").alias("bytes")), "node")
            weight = F.ceil((F.col("bytes") + 8) / (8 * WEIGHT))
        cells = _cells(cut(family), shard, weight).join(more, "node")
        tested = cut(_compared(cells, TABLES, similar))
        if not tested.isEmpty():
            kept, parts = kept.union(tested), components(_stars(parts).union(tested))
    return kept, parts


def links(nodes: DataFrame, shard: int = SHARD, sets: Sets | None = None) -> DataFrame:
    """The links of ``joined``."""
    return joined(nodes, shard, sets)[0]


def _shingled(rows: DataFrame, table: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the rows of ``table`` that ``node`` names."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            raw = (t.as_buffer().to_pybytes() for t in own["text"].cast(pa.large_binary()))
            yield batch(schema, own["_row"], [shingle_set(t, words).tobytes() for t in raw])

    named = rows.select(F.col("node").alias("_row")).distinct()
    whole = texts(table.join(named, "_row", "left_semi"), "_row").select("_row", "text")
    return cut(whole.mapInArrow(hashed, "node long, shingles binary"))


def _similar(pairs: DataFrame, sets: Sets, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets are similar enough."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            keep = []
            for left, right in zip(own["left"], own["right"]):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both))
            yield own.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    found = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left, right = (found.select(F.col("node").alias(n), F.col("shingles").alias(side)) for n, side in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compared, "a long, b long")


def one_of_each(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay: of every group of near duplicates the least doc_id.

    All columns are kept. Null text counts as empty; texts without words are one group. Null
    doc_ids come last, repeated rows are near duplicates. An empty table gives no rows.
    """
    # The numbered rows are written, as row numbers of a scan are only sure within one pass.
    table = cut(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    rows = table.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), "_row")
    own = cut(marks(rows, words))
    nodes = own.groupBy(*_WHOLE, *_SET).agg(F.min("_row").alias("node"))
    _, parts = joined(nodes, sets=lambda wanted: _shingled(wanted, rows, words), similar=similar)
    grouped = own.join(nodes, [*_WHOLE, *_SET]).join(parts, "node", "left")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "_row"))
    stay = grouped.groupBy(F.coalesce("component", "node").alias("group")).agg(least.alias("least"))
    return table.join(stay.select(F.col("least._row").alias("_row")), "_row", "left_semi").select("_doc.*")
