"""Texts of an Arrow stream as flat byte blocks, and array operations on the words in them.

A block is the concatenation of whole texts. Its byte-level arrays cost about eight bytes for
each byte of text, so blocks are small (``BLOCK_BYTES``); one text longer than that is a block
of its own. Everything here runs inside a task.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = (1 << 20) - 1

# White space of the word rule: space and the five controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0x2545F4914F6CDD1D


def text_column() -> Column:
    """The text as text whatever its type; null is the empty text."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def fold_of(folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``folds``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))


def texts(docs: DataFrame, *columns: Column) -> DataFrame:
    """``doc_id`` and ``text`` first, then ``columns``; other columns of the table are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), *columns)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the row borders in them."""
    array = column.cast(pa.large_binary())
    borders = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(array) == 0:
        return whole[:0], np.zeros(1, np.int64)
    return whole[borders[0] : borders[-1]], borders - borders[0]


class Block:
    """Consecutive rows of a batch: ``data`` bytes, row borders ``at``, and the rows themselves."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray):
        self.rows, self.data, self.at = rows, data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def give_back() -> None:
    """Returns what the batches of a task took to the system, as workers are used again by other
    operators; without glibc only Arrow's part of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, column: str = "text") -> Iterator[Block]:
    for batch in batches:
        data, at = flat(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield Block(
                batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            )
            first = last
    give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    if lower:
        values = values[np.frombuffer(LOWER, np.uint8)]
    return values


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            steps = np.ones(size, np.uint64)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps[1:] = b
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_BASE)


class Hasher:
    """64-bit hashes of any substrings of one block, from prefix sums."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self._down = _POWERS.get(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(lower)[data] * up[: len(data)], out=self._sums[1:])

    def plain(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mixed(self.plain(start, end) + length * np.uint64(_MULTIPLIER))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes from each place."""
        count = max(0, len(self._sums) - n)
        return mixed((self._sums[n:] - self._sums[:count]) * self._down[:count])


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n + 1 entries)."""
    inside = ~SPACE[block.data]
    border = np.zeros(len(inside) + 1, bool)
    border[block.at] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, block.at)


# White space outside ASCII, and the four separators some libraries count as white space.
_ODD_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)


class Parts:
    """The parts of the texts of a block, each with a hash, and the different ones among them.

    ``first`` has for each row the index of its first part (n + 1 entries). Byte-level arrays are
    made for some rows at a time, so a block may be much larger than ``BLOCK_BYTES``.
    """

    def __init__(self, block: Block, whole: bool, lower: bool = False):
        """``whole``: parts are words with the white space before them, and together the text.

        A text with unusual white space is then a single part, so that a tokenizer's pattern
        sees its white space in one piece.
        """
        starts, ends, hashes, first = [], [], [], [np.zeros(1, np.int64)]
        done = row = 0
        while row < len(block):
            last = max(row + 1, int(np.searchsorted(block.at, block.at[row] + BLOCK_BYTES, "right")) - 1)
            base = block.at[row]
            piece = Block(None, block.data[base : block.at[last]], block.at[row : last + 1] - base)
            s, e, f = _wholes(piece) if whole else words(piece)
            starts.append(s + base)
            ends.append(e + base)
            hashes.append(Hasher(piece.data, lower).of(s, e))
            first.append(f[1:] + done)
            done += len(s)
            row = last
        none = [np.zeros(0, np.int64)]
        self.block = block
        self.starts, self.ends = np.concatenate(starts or none), np.concatenate(ends or none)
        self.hashes = np.concatenate(hashes or none).astype(np.uint64)
        self.first = np.concatenate(first)

    def __len__(self) -> int:
        return len(self.starts)

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The different parts, and for each part the index among them."""
        _, at, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        raw = self.block.data.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())], which


def _wholes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, word_ends, _ = words(block)
    sizes = np.diff(block.at)
    # Borders: ends of words and, where white space ends a text, the end of the text.
    border = np.zeros(len(block.data) + 1, bool)
    border[word_ends] = True
    raw = block.data.tobytes()
    for match in _ODD_SPACE.finditer(raw):
        row = int(np.searchsorted(block.at, match.start(), "right")) - 1
        border[block.at[row] + 1 : block.at[row + 1]] = False
    border[block.at[1:][sizes > 0]] = True
    ends = np.flatnonzero(border)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return starts, ends, np.searchsorted(starts, block.at)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each row, rows given by the index of their first value."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes ``first[i] .. first[i] + length[i] - 1`` for all i, one after the other."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - length), length)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
