"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document's ids and its end id are cut into pieces by its own length alone: full sequences
first, then the largest unit fractions of the capacity (1/2, 1/3, 1/4, ...) that fit, until at
most 1/``FINE`` of the capacity is left. A piece of length l belongs to class j = capacity // l
and every sequence of class j gets exactly j pieces. So a worker fills sequences without
looking at any other, and what a sequence wastes is the difference between its pieces and the
unit fraction: nothing or a few ids for the cut pieces, under 1/``FINE`` for the small ends.

Each task keeps fewer than j pieces open in each class. The open pieces of ``FAN`` tasks meet
in the next round and are filled the same way; the last round leaves fewer than j pieces in
each class, a number that depends on the capacity alone, and these are packed first-fit by
decreasing length.

The string of an added token of the tokenizer file, such as ``<|endoftext|>``, is that token's id
wherever a text has it, inside words too, as the tokenizers library gives it.

Null text counts as empty: its only id is the end id. Repeated rows are documents of their own;
null doc_ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Block, Parts, batch, blocks, row_sums, spread, texts
from .vocabulary import ranks

CAPACITY = 2048
END = 1
FINE = 16
FAN = 64
BLOCK = 4 << 20
KNOWN = 120_000
# Printable ASCII and white space, and the letters U+00C0 to U+017F.
_PLAIN = re.compile(rb"(?:[\t-\r -~]|[\xc3-\xc5][\x80-\xbf])*")
_ROUND_BITS, _WORKER_BITS = 59, 32  # round | worker | number in the worker
_PIECE = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
_PLACED = [("worker", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_FIELDS = ", ".join(f"{n} long" for n, _ in _PIECE + _PLACED)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> re.Pattern[bytes] | None:
    """Matches the added tokens of the file, such as an end mark: in a text they are one id each."""
    added = _tokenizer(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or len(t.content.split()) != 1 for t in added):
        raise ValueError("an added token that depends on the text around it cannot be found in single words")
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in added)) if added else None


@lru_cache(maxsize=2)
def _known(path: str) -> list[dict[bytes, bytes]]:
    """Ids of parts that this worker has met, as bytes: those met lately, and those before them."""
    return [{}, {}]


@lru_cache(maxsize=2)
def _ranked(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def _encode(distinct: list[bytes], path: str, rank_path: str | None) -> list[bytes]:
    known, tokenizer = _known(path), _tokenizer(path)
    late, early = known
    out = [late.get(d) or early.get(d) for d in distinct]
    new = [i for i, ids in enumerate(out) if ids is None]
    if rank_path is not None:
        encode, rest, added = _ranked(rank_path).encode_ordinary, [], _added(path)
        for i in new:
            if _PLAIN.fullmatch(distinct[i]) and not (added and added.search(distinct[i])):
                out[i] = array("I", encode(distinct[i].decode())).tobytes()
            else:
                rest.append(i)
        new = rest
    for at in range(0, len(new), 20_000):
        places = new[at : at + 20_000]
        texts_ = [distinct[i].decode("utf-8", "replace") for i in places]
        for i, found in zip(places, tokenizer.encode_batch_fast(texts_, add_special_tokens=False)):
            out[i] = array("I", found.ids).tobytes()
    late.update((d, ids) for d, ids in zip(distinct, out) if len(d) <= 64)
    if len(late) > KNOWN:
        known[:] = {}, late
    return out


def block_ids(block: Block, path: str, rank_path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts of a block, and the number for each text.

    Words with the white space before them are encoded once for each different one.
    """
    parts = Parts(block, whole=True)
    distinct, which = parts.distinct()
    own = _encode(distinct, path, rank_path)
    ids = np.frombuffer(b"".join(own), np.uint32)
    sizes = np.array([len(x) // 4 for x in own], np.int64)
    first = np.cumsum(np.append(0, sizes))
    size = sizes[which] if len(which) else sizes
    every = ids[spread(first[which], size)] if len(which) else ids
    return every, row_sums(size, parts.first)


def lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left:
        j = capacity // left
        piece = left if j >= FINE or left == capacity // j else capacity // (j + 1)
        out.append(piece)
        left -= piece
    return out


class Filler:
    """Open sequences of one worker: ``add`` returns the rows of a sequence once it is full."""

    def __init__(self, number: int, capacity: int):
        self.number, self.capacity = number, capacity
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> list[tuple]:
        j = self.capacity // piece[2]
        held = self.open[j]
        held.append(piece)
        return self.close(self.open.pop(j)) if len(held) == j else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        self.number += 1
        rows, at = [], 0
        for p in pieces:
            rows.append((*p, None, self.number, at))
            at += p[2]
        return rows

    def rest(self, worker: int) -> list[tuple]:
        return [(*p, worker, None, None) for held in self.open.values() for p in held]


_SCHEMA = pa.schema(_PIECE + _PLACED)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield batch(_SCHEMA, *zip(*rows))


def _tokenise(docs: DataFrame, path: str, rank_path: str | None, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        filler = Filler(worker << _WORKER_BITS, capacity)
        for block in blocks(batches, limit=BLOCK):
            ids, sizes = block_ids(block, path, rank_path)
            borders = np.cumsum(np.append(0, sizes)).tolist()
            ids, end = ids.astype("<u4"), np.array([END], "<u4").tobytes()
            out: list[tuple] = []
            for doc, s, e in zip(block.rows["doc_id"].to_pylist(), borders, borders[1:]):
                raw, n, at = ids[s:e].tobytes() + end, e - s + 1, 0
                for length in lengths(n, capacity):
                    crc = zlib.crc32(memoryview(raw)[4 * at : 4 * (at + length)])
                    out += filler.add((doc, at, length, crc, n))
                    at += length
            yield from _rows(out)
        yield from _rows(filler.rest(worker))

    return docs.mapInArrow(run, _FIELDS)


def _refill(rest: DataFrame, turn: int, last: bool, capacity: int) -> DataFrame:
    """The open pieces of up to ``FAN`` workers, filled as one worker would; the last one packs all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = None
        worker = -1
        out: list[tuple] = []

        def done() -> list[tuple]:
            if filler is None:
                return []
            if not last:
                return filler.rest(worker)
            return [r for bin_ in first_fit(filler, capacity) for r in filler.close(bin_)]

        for rows in batches:
            columns = [rows[n].to_pylist() for n, _ in [*_PIECE, _PLACED[0]]]
            for *piece, owner in zip(*columns):
                if owner != worker:
                    out += done()
                    worker = owner
                    filler = Filler((turn << _ROUND_BITS) + (owner << _WORKER_BITS), capacity)
                out += filler.add(tuple(piece))
            yield from _rows(out)
            out = []
        yield from _rows(out + done())

    return rest.repartition("worker").sortWithinPartitions("worker").mapInArrow(run, _FIELDS)


def first_fit(filler: Filler, capacity: int) -> list[list[tuple]]:
    """Open pieces by decreasing length, each into the first sequence with room."""
    bins: list[list[tuple]] = []
    room: list[int] = []
    for piece in sorted((p for held in filler.open.values() for p in held), key=lambda p: -p[2]):
        at = next((i for i, r in enumerate(room) if r >= piece[2]), None)
        if at is None:
            at = len(bins)
            bins.append([])
            room.append(capacity)
        bins[at].append(piece)
        room[at] -= piece[2]
    return bins


def pack(docs: DataFrame, path: str, rank_path: str | None = None, capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path``: a file of the tokenizers library, the same on every machine. ``rank_path``: the
    same vocabulary as ranks, if there is one; words of ASCII and of Latin letters that Unicode
    has had from the start are then encoded by tiktoken, which gives the same ids and is faster.
    """
    parts = [cut(_tokenise(texts(docs), path, rank_path, capacity))]
    workers = parts[0].agg(F.max("worker")).first()[0]  # one number
    turn = 0
    while workers is not None:
        turn, workers = turn + 1, workers // fan
        rest = parts[-1].filter("sequence_id IS NULL").withColumn("worker", F.floor(F.col("worker") / fan))
        parts.append(cut(_refill(rest, turn, workers == 0, capacity)))
        if workers == 0:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.filter("sequence_id IS NOT NULL").select(*[n for n, _ in _PIECE], "sequence_id", "offset")
