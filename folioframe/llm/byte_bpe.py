"""Byte-level BPE: ranked merges folded over the different words of a block, and decoding.

A text is split by the tokenizer's pattern. Each different match of a block starts as its
bytes; in every round each match merges its leftmost pair of lowest rank, for all matches of
one length at once on arrays, until no pair has a rank. Very long matches fold one by one with
a heap. Decoding concatenates the bytes of the ids.

The fold runs beside the texts, in the task that has them: bringing ids of words back to
their places through a shuffle would move several times the input. Spark's higher-order
functions gave the same ids at many times the cost; the README has the figures.

Null text counts as empty: no ids. Null doc_ids and repeated rows are rows of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Parts, batch, blocks, spread, texts
from .vocabulary import ranks

BLOCK = 3 << 20
LONG = 64  # bytes of a match from which on it folds alone
_NONE = np.int32(2**31 - 1)


class Merges:
    """The rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def fold(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges the rows of a matrix; gives (row numbers, their ids) as rows are finished."""
        rows = np.arange(len(ids))
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            if width == 1:
                yield rows, ids
                return
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), at]
            going = least != _NONE
            if not going.all():
                yield rows[~going], ids[~going]
                rows, ids, rank, at, least = (x[going] for x in (rows, ids, rank, at, least))
            n = np.arange(len(rows))
            ids[n, at] = least
            stays = np.ones(ids.shape, bool)
            stays[n, at + 1] = False
            ids = ids[stays].reshape(len(rows), width - 1)
            stays = np.ones(rank.shape, bool)
            stays[n, at] = False
            rank = rank[stays].reshape(len(rows), width - 2)
            for place in (at - 1, at):  # the pairs on both sides of the merged one
                ok = (place >= 0) & (place < width - 2)
                rank[n[ok], place[ok]] = self.rank(ids[n[ok], place[ok]], ids[n[ok], place[ok] + 1])

    def fold_long(self, raw: bytes) -> list[int]:
        """One long match: the same merges with a heap of ranked pairs over a linked list."""
        ids = self.bytes[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_of, heap = self.pairs, []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else len(ids)
            if j < len(ids) and (r := rank_of.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def encode(self, matches: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(matches)
        by_size: dict[int, list[int]] = {}
        for i, match in enumerate(matches):
            if (whole := self.ranks.get(match)) is not None:
                out[i] = [whole]
            elif len(match) > LONG:
                out[i] = self.fold_long(match)
            else:
                by_size.setdefault(len(match), []).append(i)
        for size, places in by_size.items():
            raw = np.frombuffer(b"".join([matches[i] for i in places]), np.uint8).reshape(-1, size)
            for rows, ids in self.fold(self.bytes[raw]):
                for row, own in zip(rows.tolist(), ids.tolist()):
                    out[places[row]] = own
        return out


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in order of rank, and where each begins."""
    table = {rank: token for token, rank in ranks(path).items()}
    pieces = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])


def decoded(lists: pa.ListArray, path: str) -> pa.Array:
    """The bytes of each list of ids."""
    data, first = _pieces(path)
    ids, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(first)
    joined = data[spread(first[ids], size[ids])].tobytes() if len(ids) else b""
    borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ends = np.cumsum(np.append(0, size[ids]))[borders].tolist()
    return pa.array([joined[s:e] for s, e in zip(ends, ends[1:])], pa.binary())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``decoded``, the bytes of its ``ids``; null ids are none."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                yield batch(schema, part["doc_id"], decoded(part["ids"], path))

    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return encoded.select("doc_id", ids.alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, the token ``ids`` of every row and ``decoded``, the bytes they decode to.

    ``path``: a rank file, the same on every machine.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = _merges(path), regex.compile(pattern)
        for block in blocks(batches, limit=BLOCK):
            parts = Parts(block, whole=True)
            distinct, which = parts.distinct()
            number: dict[str, int] = {}
            sizes, matches = [], []
            for part in distinct:
                found = split.findall(part.decode("utf-8", "replace"))
                sizes.append(len(found))
                matches += [number.setdefault(m, len(number)) for m in found]
            ids = merges.encode([m.encode() for m in number])
            # Ids of each match, then of each part, then of each text, always as one flat array.
            flat_ids = np.array([x for own in ids for x in own], np.int32)
            size = np.array([len(own) for own in ids], np.int64)
            first = np.cumsum(np.append(0, size))
            matches = np.array(matches, np.int64)
            part_ids = flat_ids[spread(first[matches], size[matches])] if len(matches) else flat_ids
            ends = np.cumsum(np.append(0, size[matches]))[np.cumsum(np.append(0, np.array(sizes, np.int64)))]
            size = np.diff(ends)
            own = part_ids[spread(ends[which], size[which])] if len(which) else part_ids
            borders = np.cumsum(np.append(0, size[which] if len(which) else size))[parts.first]
            lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(own, pa.int32()))
            for at in range(0, len(lists), 500):
                part = lists.slice(at, 500)
                yield batch(schema, block.rows["doc_id"].slice(at, 500), part, decoded(part, path))

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
