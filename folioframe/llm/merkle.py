"""Merkle manifest of a table of documents, audited by octopus multiproofs.

Every row is a leaf. The leaves of one source, ascending by doc_id, form a tree of runs of
three whose top is the subroot of the source; the subroots, ordered by source, form a second
tree whose top is the root of the manifest.

Only digests are shuffled, never texts. Leaves get their place in their source and their
source's place by the ordered scan, so a source with a third of all rows is spread like any
other. Trees are built in passes of ``DEPTH`` levels: a task takes whole tiles of
``3 ** DEPTH`` neighbouring nodes and a pass sends on one node of each tile.

An audit goes by blocks of ``BLOCK`` neighbouring leaves. A block knows all nodes that its own
leaves determine; the octopus of the block is the least set of further nodes from which every
path up to the root follows, at most four for each level at the two ends of the block, however
many leaves or whole sources it holds. These coordinates are fetched once, by one join for all
blocks; the task then derives the shared interior nodes and expands the proof of each leaf.

Null fields are written ``-``. A null doc_id comes first in its source and a null source is
the first source. Rows that repeat a doc_id are ordered by their leaf digest, so equal rows are
interchangeable. An empty table has no rows and no root. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scan
from ..session import cut
from .blocks import batch

FAN = 3
DEPTH = 6  # levels of one pass
BLOCK = 1 << 13  # leaves that are proved together
_ROOT_TREE = -1
_META = -1  # level under which the number of leaves of a tree is sent


def leaf_digest(text: Column) -> Column:
    """Digest of a row with ``text`` in the place of its text."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    columns = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*map(field, columns)), 256)


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    return [digest(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]


def _place(docs: DataFrame, presented: Column, block: int) -> DataFrame:
    """Leaves with ``tree`` (place of the source), ``pos`` in it and ``block``."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_digest(F.col("text")).alias("leaf"),
        leaf_digest(presented).alias("presented"),
    )
    placed = scan.place(rows, ["source", "doc_id", "leaf", "presented"])
    placed = scan.run(placed, ["source"], {"pos": ("count", F.lit(1))}).withColumn("pos", F.col("pos") - 1)
    starts = F.when(F.col("pos") == 0, 1).otherwise(0)
    placed = scan.run(placed, [], {"tree": ("sum", starts), "at": ("count", F.lit(1))})
    return cut(
        placed.select(
            "doc_id",
            "leaf",
            "presented",
            "pos",
            (F.col("tree") - 1).alias("tree"),
            F.floor((F.col("at") - 1) / block).alias("block"),
        )
    )


_NODE = "tree long, level int, pos long, digest string, top boolean, open boolean"


def _climb_tiles(nodes: DataFrame, level: int, depth: int) -> DataFrame:
    """One pass: the nodes above ``nodes(tree, pos, digest)`` up to ``depth`` levels.

    ``top`` is the top of a tree; ``open`` are the nodes that the next pass starts from.
    """
    size = FAN**depth
    schema = pa.schema(
        [("tree", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string()),
         ("top", pa.bool_()), ("open", pa.bool_())]
    )

    def tile(tree: int, number: int, digests: list[str], out: list[tuple]) -> None:
        # Only a first tile that is not full can be the only one of its tree and end early.
        lone = number == 0 and len(digests) < size
        at = number * size
        for up in range(1, depth + 1):
            if lone and len(digests) == 1:
                break
            digests, at = parents(digests), at // FAN
            last = up == depth and not lone
            out += [(tree, level + up, at + i, d, False, last) for i, d in enumerate(digests)]
        else:
            up = depth + 1
        if lone:
            out.append((tree, level + up - 1, 0, digests[0], True, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for rows in batches:
            tree, number = rows["tree"].to_numpy(), rows["pos"].to_numpy() // size
            digests = rows["digest"].to_pylist()
            borders = np.flatnonzero((np.diff(tree) != 0) | (np.diff(number) != 0)) + 1
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), rows.num_rows]):
                if a == b:
                    continue
                here = int(tree[a]), int(number[a])
                if key is not None and here != key:
                    tile(*key, held, out)
                    held = []
                key, held = here, held + digests[a:b]
            if out:
                yield batch(schema, *zip(*out))
                out = []
        if key is not None:
            tile(*key, held, out)
            yield batch(schema, *zip(*out))

    tiles = nodes.select("tree", "pos", "digest").repartition("tree", F.floor(F.col("pos") / size))
    return tiles.sortWithinPartitions("tree", "pos").mapInArrow(run, _NODE)


def build(leaves: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """All interior nodes ``(tree, level, pos, digest)`` and the tops ``(tree, digest)`` of the
    trees over ``leaves(tree, pos, digest)``."""
    largest = leaves.agg(F.max("pos")).first()[0]  # one number
    passes, level, below = [], 0, leaves
    while True:
        passes.append(cut(_climb_tiles(below, level, depth)))
        level += depth
        below = passes[-1].filter("open")
        # The last pass sees one tile of each tree, and that tile is not full.
        if largest is None or largest + 1 < FAN**depth:
            break
        largest //= FAN**depth
    nodes = passes[0]
    for more in passes[1:]:
        nodes = nodes.union(more)
    return nodes.filter("NOT top").select("tree", "level", "pos", "digest"), nodes.filter("top").select("tree", "digest")


def octopus(n: int, low: int, high: int) -> list[tuple[int, int]]:
    """Coordinates ``(level, pos)`` that leaves ``low .. high - 1`` of a tree of ``n`` leaves
    miss on their way to its top, none of which follows from the others."""
    out, level = [], 0
    while n > 1:
        first, last = low // FAN * FAN, min(n, -(-high // FAN) * FAN)
        out += [(level, i) for i in (*range(first, low), *range(high, last))]
        n, low, high, level = -(-n // FAN), low // FAN, -(-high // FAN), level + 1
    return out


def levels(known: list[str], low: int, n: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """For each level the first place and the nodes of the whole runs that hold ``known``."""
    out, level = [], 0
    while n > 1:
        high = low + len(known)
        first, last = low // FAN * FAN, min(n, -(-high // FAN) * FAN)
        row = [fetched[level, i] for i in range(first, low)] + known + [fetched[level, i] for i in range(high, last)]
        out.append((first, row))
        known, low, n, level = parents(row), first // FAN, -(-n // FAN), level + 1
    return out + [(0, known)]


def siblings(rows: list[tuple[int, list[str]]], pos: int) -> str:
    """Digests beside the path from ``pos`` to the top, level by level, left to right."""
    out = []
    for first, row in rows[:-1]:
        start = (pos - first) // FAN * FAN
        out += [d for i, d in enumerate(row[start : start + FAN], first + start) if i != pos]
        pos //= FAN
    return "".join(out)


def fold(node: str, rows: list[tuple[int, list[str]]], pos: int) -> str:
    """The top that follows from ``node`` in the place ``pos`` and its siblings."""
    for first, row in rows[:-1]:
        start = (pos - first) // FAN * FAN
        run = row[start : start + FAN]
        run[pos - first - start] = node
        node, pos = digest(run), pos // FAN
    return node


def _requests(blocks: DataFrame) -> DataFrame:
    """The octopus of each block, and the sizes of the trees at its ends."""
    schema = pa.schema([("block", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                a, b, block = r["first_tree"], r["last_tree"], r["block"]
                if a == b:
                    wanted = [(a, c) for c in octopus(r["first_n"], r["first_pos"], r["last_pos"] + 1)]
                else:
                    wanted = [(a, c) for c in octopus(r["first_n"], r["first_pos"], r["first_n"])]
                    wanted += [(b, c) for c in octopus(r["last_n"], 0, r["last_pos"] + 1)]
                wanted += [(_ROOT_TREE, c) for c in octopus(r["trees"], a, b + 1)]
                out += [(block, tree, level, pos) for tree, (level, pos) in wanted]
                out += [(block, t, _META, n) for t, n in {a: r["first_n"], b: r["last_n"]}.items()]
            if out:
                yield batch(schema, *zip(*out))

    return blocks.mapInArrow(run, "block long, tree long, level int, pos long")


_PROVED = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def verify(docs: DataFrame, presented: Column | None = None, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: its leaf, subroot and root, the digest of its proof, and
    the root that follows when ``presented`` is shown as its text."""
    leaves = _place(docs, F.col("text") if presented is None else presented, block)
    level0 = leaves.select("tree", "pos", F.col("leaf").alias("digest"))
    nodes, tops = build(level0, depth)
    subroots = tops.select(F.lit(_ROOT_TREE).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    root_nodes, root_top = build(subroots, depth)
    root = root_top.first()  # one row, none for an empty table
    root = root.digest if root else ""
    trees = tops.count()

    sizes = leaves.groupBy("tree").agg((F.max("pos") + 1).alias("n"))
    place = F.struct("tree", "pos")
    ends = leaves.groupBy("block").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    ends = ends.select(
        "block",
        F.col("a.tree").alias("first_tree"),
        F.col("a.pos").alias("first_pos"),
        F.col("b.tree").alias("last_tree"),
        F.col("b.pos").alias("last_pos"),
        F.lit(trees).cast("long").alias("trees"),
    )
    ends = ends.join(sizes.select(F.col("tree").alias("first_tree"), F.col("n").alias("first_n")), "first_tree")
    ends = ends.join(sizes.select(F.col("tree").alias("last_tree"), F.col("n").alias("last_n")), "last_tree")
    requests = cut(_requests(ends))
    zero = F.lit(0).alias("level")
    stored = nodes.union(root_nodes)
    for rows in (level0, subroots):
        stored = stored.union(rows.select("tree", zero, "pos", "digest"))
    fetched = requests.join(stored, ["tree", "level", "pos"]).select("block", "tree", "level", "pos", "digest")
    fetched = fetched.union(requests.filter(F.col("level") == _META).select("*", F.lit(None).cast("string")))

    schema = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
         ("verified", pa.bool_())]
    )

    def expand(mine: pa.Table, others: pa.Table) -> pa.Table:
        tree, pos = mine["tree"].to_numpy(), mine["pos"].to_numpy()
        mine = mine.take(np.lexsort((pos, tree)))
        tree, pos = mine["tree"].to_numpy(), mine["pos"].to_numpy()
        got: dict[int, dict[tuple[int, int], str]] = {}
        for r in others.to_pylist():
            got.setdefault(r["tree"], {})[r["level"], r["pos"]] = r["digest"]
        counts = {t: next(p for level, p in d if level == _META) for t, d in got.items() if t != _ROOT_TREE}
        leaf, shown = mine["leaf"].to_pylist(), mine["presented"].to_pylist()
        borders = (np.flatnonzero(np.diff(tree)) + 1).tolist()
        spans = list(zip([0, *borders], [*borders, len(tree)]))
        below = []
        for a, b in spans:
            t = int(tree[a])
            below.append(levels(leaf[a:b], int(pos[a]), counts.get(t, b - a), got.get(t, {})))
        above = levels([rows[-1][1][0] for rows in below], int(tree[0]), trees, got.get(_ROOT_TREE, {}))
        out = []
        for (a, b), rows in zip(spans, below):
            t, subroot = int(tree[a]), rows[-1][1][0]
            upper = siblings(above, t).encode()
            for i, p in enumerate(pos[a:b].tolist(), a):
                proof = sha256(siblings(rows, p).encode() + upper).hexdigest()
                folded = fold(fold(shown[i], rows, p), above, t)
                out.append((leaf[i], subroot, root, proof, folded, folded == root))
        return pa.Table.from_arrays(
            [mine["doc_id"].combine_chunks(), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema
        )

    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(expand, _PROVED)
