"""Piece counts by greedy longest match, in time linear in the text.

The vocabulary is a trie. A node that ends no token knows how many tokens the longest-match
rule has settled once the walk fails there, and the node where the rest of its string goes on
(its failure link). Counting a word is then one step for each byte and one for each failure;
no piece is built and nothing is scanned twice.

A word is the text between white space, looked up with a leading space, as the vocabulary marks
the start of a word that way. A word with a byte that starts no token is one unknown piece.

Null text counts as empty: no words, no pieces. Null doc_ids and repeated rows are rows of
their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Parts, batch, blocks, row_sums, texts
from .vocabulary import ranks

BLOCK = 6 << 20


class Automaton:
    """Trie of ``tokens`` with failure links and the number of tokens each failure settles."""

    def __init__(self, tokens: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node; 0 is the root
        final = [False]
        depths: list[list[tuple[int, int, int]]] = []
        for token in tokens:
            node = 0
            for depth, byte in enumerate(token):
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(final)
                    final.append(False)
                    if depth == len(depths):
                        depths.append([])
                    depths[depth].append((node, byte, self.step[key]))
                node = self.step[key]
            final[node] = bool(node)
        self.settled = [0] * len(final)
        self.failure: list[int | None] = [None] * len(final)
        for parent, byte, node in (x for level in depths for x in level):
            if final[node]:
                self.settled[node], self.failure[node] = 1, 0
                continue
            count, rest = self.settled[parent], self.failure[parent]
            while rest is not None and (rest << 8 | byte) not in self.step:
                count += self.settled[rest]
                rest = self.failure[rest]
            if rest is not None:
                self.settled[node], self.failure[node] = count, self.step[rest << 8 | byte]

    def count(self, word: bytes) -> int | None:
        """Pieces of a word, or None if it has none."""
        step, settled, failure = self.step, self.settled, self.failure
        node = total = 0
        for byte in word:
            while (after := step.get(node << 8 | byte)) is None:
                total += settled[node]
                node = failure[node]
                if node is None:
                    return None
            node = after
        while node:
            total += settled[node]
            node = failure[node]
            if node is None:
                return None
        return total


@lru_cache(maxsize=2)
def _automaton(path: str) -> Automaton:
    return Automaton(ranks(path))


def count(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_pieces, n_unknown (words)."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_pieces", "n_unknown")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(path)
        for block in blocks(batches, limit=BLOCK):
            parts = Parts(block, whole=False)
            distinct, which = parts.distinct()
            counts = [automaton.count(b" " + word) for word in distinct]
            unknown = np.array([c is None for c in counts], bool)
            pieces = np.array([1 if c is None else c for c in counts], np.int64)
            yield batch(
                schema, block.rows["doc_id"], np.diff(parts.first),
                row_sums(pieces[which], parts.first), row_sums(unknown[which], parts.first),
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")
