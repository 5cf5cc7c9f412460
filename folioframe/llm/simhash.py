"""Near duplicates by SimHash fingerprints, found with BK-trees.

Fingerprints are distinct before they are compared. Two fingerprints with at most r differing
bits agree on one of r + 1 disjoint blocks of bits, so a shard is a choice of blocks and the
bits in them; choosing again among the bits that are left gives smaller shards. Every shard
larger than ``SHARD`` is split that way until none is, which loses no pair and ends because
the bits run out. A task builds the BK-tree of each of its shards, children keyed by their
distance to the parent, and follows only the edges that can hold a match. Shards are not sent
to all tasks: together they grow with the corpus, while a shard is bounded. Of the links found
in a shard only those that join two parts are returned, so copies never give all pairs.

Null text counts as empty. A text without words has fingerprint zero, and links like any
other. Null doc_ids take part but are never a component's name; a component of nothing but
nulls has a null name. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import LOWER, batch, texts
from .components import components

SHARD = 2048  # fingerprints in one BK-tree at most
LEVELS = 2  # choices of blocks before shards are counted
BITS = 64

_SET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(raw: bytes, words: int) -> bytes:
    """XXH64 (seed 42) of every shingle of a text, big-endian and joined."""
    found = raw.translate(LOWER).split()  # bytes.split() has the white space of the word rule
    if not found:
        return b""
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_digest(joined, 42)
    at = list(accumulate(map(len, found), lambda x, n: x + n + 1, initial=0))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s : e - 1], 42) for s, e in zip(at, at[words:])])


def majority_bits(rows: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of eight bytes."""
    counts = np.bincount((rows + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _SET_BITS
    return counts.ravel() * 2 > len(rows)


def majority(hashes: bytes) -> int:
    """The fingerprint of joined hashes, as a signed 64-bit number."""
    return int(np.packbits(majority_bits(np.frombuffer(hashes, np.uint8).reshape(-1, 8))).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and 64-bit ``fp`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            marks = [
                majority(shingle_hashes(t.as_buffer().to_pybytes(), words)) for t in rows["text"].cast(pa.large_binary())
            ]
            yield batch(schema, rows["doc_id"], marks)

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=64)
def block_masks(level: int, radius: int) -> tuple[int, ...]:
    """The bits chosen on each of the (radius + 1) ** level ways of choosing blocks."""
    if level == 0:
        return (0,)
    out = []
    for chosen in block_masks(level - 1, radius):
        left = [b for b in range(BITS) if not chosen >> b & 1]
        for part in np.array_split(np.array(left), radius + 1):
            out.append(chosen | sum(1 << int(b) for b in part))
    return tuple(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shards(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """``fp, way`` with one more choice of blocks; ``way`` numbers the choices made so far."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(level, radius)])
    ways = F.explode(F.array(*[F.col("way") * (radius + 1) + c for c in range(radius + 1)]))
    return rows.select("fp", ways.alias("way")).withColumn(
        "bits", F.col("fp").bitwiseAND(F.element_at(masks, (F.col("way") + 1).cast("int")))
    )


class BKTree:
    """Fingerprints by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def near(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.nodes else []
        while todo:
            own, children = self.nodes[i := todo.pop()]
            d = (own ^ fp).bit_count()
            if d <= radius:
                found.append(i)
            if children:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return found

    def add(self, fp: int) -> int:
        self.nodes.append((fp, {}))
        at, new = 0, len(self.nodes) - 1
        while new:
            own, children = self.nodes[at]
            d = (own ^ fp).bit_count()
            if d not in children:
                children[d] = new
                break
            at = children[d]
        return new


class Parts:
    """Sets of places that are joined so far."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Joins two sets; false if they are one already."""
        i, j = self.top(i), self.top(j)
        self.root[i] = j
        return i != j


def shard_links(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of places that join all fingerprints (not negative) within the radius, directly or in steps."""
    if len(fps) == 2:  # most shards
        if (fps[0] ^ fps[1]).bit_count() <= radius:
            yield 0, 1
        return
    tree, parts = BKTree(), Parts(len(fps))
    for fp in fps:
        near = tree.near(fp, radius)
        new = tree.add(fp)
        for i in near:
            if parts.join(i, new):
                yield i, new


def nearest_links(fps: list[int], radius: int, groups: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """As ``shard_links`` with the distance, the closest pairs first: a least spanning tree.
    Fingerprints of one of the ``groups`` are joined to begin with.

    Two fingerprints are then joined in steps that are each no longer than their own distance.
    """
    tree, parts, pairs = BKTree(), Parts(len(fps)), []
    seen: dict[int, int] = {}
    for i, group in enumerate(groups or []):
        parts.join(i, seen.setdefault(group, i))
    for j, fp in enumerate(fps):
        pairs += [(fp ^ fps[i]).bit_count() << 48 | i << 24 | j for i in tree.near(fp, radius)]
        tree.add(fp)
    for pair in sorted(pairs):
        i, j = pair >> 24 & 0xFFFFFF, pair & 0xFFFFFF
        if parts.join(i, j):
            yield i, j, pair >> 48


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(fps: np.ndarray) -> list[tuple[int, int]]:
        found = shard_links(fps.view(np.uint64).tolist(), radius)
        return [(fps[i], fps[j]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the shard that may go on in the next batch
        for rows in batches:
            new = np.stack([rows[c].to_numpy(zero_copy_only=False) for c in ("way", "bits", "fp")]).astype(np.int64)
            new = np.concatenate([held, new], axis=1)
            starts = np.flatnonzero(np.any(new[:2, 1:] != new[:2, :-1], axis=0)) + 1
            borders = np.concatenate(([0], starts)) if new.shape[1] else starts
            links = []
            for s, e in zip(borders[:-1], borders[1:]):
                if e - s > 1:
                    links += linked(np.ascontiguousarray(new[2, s:e]))
            held = new[:, borders[-1] :] if len(borders) else new
            if links:
                yield batch(schema, *zip(*links))
        links = linked(np.ascontiguousarray(held[2])) if held.shape[1] > 1 else []
        if links:
            yield batch(schema, *zip(*links))

    placed = shards.repartition("way", "bits").sortWithinPartitions("way", "bits")
    return placed.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, enough to connect all within the radius."""
    level, found = 0, []
    rows = fps.select("fp").distinct().withColumn("way", F.lit(0).cast("long"))
    while True:
        level += 1
        rows = _shards(rows, level, radius)
        if level < LEVELS:
            continue
        rows = cut(rows)
        sizes = rows.groupBy("way", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        small, large = sizes.filter(F.col("n") <= shard), sizes.filter(F.col("n") > shard)
        found.append(_tree_links(rows.join(small.select("way", "bits"), ["way", "bits"]), radius))
        if large.isEmpty():
            break
        rows = rows.join(large.select("way", "bits"), ["way", "bits"], "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id (the least doc_id it is linked to)."""
    marks = cut(fingerprints(docs, words))
    least = marks.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    parts = components(links(marks, radius)).withColumnRenamed("node", "fp")
    placed = least.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = placed.join(names, "component").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")
