"""Quality rules from tokeniser fertility, after two plain rules on the words.

A public SentencePiece vocabulary encodes the words of a text. Ordinary text of a language has
a typical number of characters for each token, few tokens that fall back to bytes, and a token
entropy that grows with the length of the text; symbol soup, tables, shouting and boilerplate
leave these bands. Bands belong to a language (``lang``), and to the main script of the text
where the language has none. ``BANDS`` are parameters.

Small texts scatter more, so the limits give way as the number of tokens falls.

Null text has no words: it fails the plain rules. A null ``lang`` takes the script's band. Null
doc_ids and repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Block, Parts, batch, blocks, mixed, row_sums, spread, texts

BLOCK = 3 << 20
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30  # words; percent of words in repeated windows
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Band(NamedTuple):
    """Limits of a text with many tokens: characters for each token, share of byte tokens, entropy.

    The entropy limit is ``entropy`` bits at 1,000 tokens and changes by ``slope`` bits for each
    doubling.
    """

    low: float
    high: float
    bytes: float
    entropy: float
    slope: float


# Measured on labelled texts of good quality: the medians of each language, less 3.5 % of the
# characters for each token and 5.5 % of the entropy. The bands of scripts are wide.
BANDS = {
    "en": Band(2.14, 2.40, 0.1, 6.33, 0.21),
    "de": Band(2.16, 2.42, 0.1, 6.17, 0.18),
    "fr": Band(1.91, 2.14, 0.1, 6.11, 0.14),
    "es": Band(1.87, 2.10, 0.1, 6.21, 0.17),
    "latin": Band(1.60, 6.00, 0.1, 5.60, 0.14),
    "greek": Band(0.80, 4.00, 0.3, 4.50, 0.10),
    "cyrillic": Band(1.00, 5.00, 0.3, 4.50, 0.10),
}
CHARS_GIVE, ENTROPY_GIVE = 0.9, 6.0  # over the root of the tokens; over the tokens


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = np.array([processor.is_byte(i) for i in range(processor.vocab_size())])
    return processor, byte


def repeated_windows(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, whether it is in a window of words that its text has twice or more."""
    n = len(hashes)
    if n < window:
        return np.zeros(n, bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = np.zeros(n - window + 1, np.uint64)
    for i in range(window):
        key = mixed(key) + hashes[i : n - window + 1 + i]
    at = np.flatnonzero(row[: len(key)] == row[window - 1 :])
    key = mixed(key[at] ^ mixed(row[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[at[again]] += 1
    edge[at[again] + window] -= 1
    return np.cumsum(edge)[:-1] > 0


def _repeated_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits of the token distribution of each row."""
    total = np.diff(first)
    row = np.repeat(np.arange(len(total)), total)
    key = np.sort(row << 20 | ids)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key))).astype(np.float64)
    own = row_sums(count * np.log2(np.maximum(count, 1)), np.searchsorted(key[new] >> 20, np.arange(len(total) + 1)))
    n = np.maximum(total, 1)
    return np.maximum(np.log2(n) - own / n, 0.0)


_SCRIPTS = (  # first code points of large runs of letters, and the script that begins there
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"),
)


def script(raw: bytes) -> str:
    """The script of most letters of a text by code point ranges; ``other`` if it has none."""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = points[(points > 0x7F) | ((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A)]
    if not len(points):
        return "other"
    slot = np.searchsorted([s for s, _ in _SCRIPTS], points, "right") - 1
    names = [_SCRIPTS[i][1] for i in slot.clip(0)] if len(points) < 64 else None
    if names is None:
        counts = np.bincount(slot.clip(0), minlength=len(_SCRIPTS))
        totals: dict[str, int] = {}
        for (_, name), n in zip(_SCRIPTS, counts.tolist()):
            totals[name] = totals.get(name, 0) + n
        return max(totals, key=totals.get)
    return max(sorted(set(names)), key=names.count)


_FIELDS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_tokens long, chars_per_token double, byte_share double, entropy double, "
    "band string, kept boolean"
)


def within(band: Band, tokens: int, chars: float, byte: float, entropy: float) -> bool:
    """Whether a text of so many tokens is inside its band."""
    n = max(tokens, 1)
    give = CHARS_GIVE / n**0.5
    least = (band.entropy + band.slope * float(np.log2(n / 1000))) * (1 - ENTROPY_GIVE / n)
    return band.low * (1 - give) <= chars <= band.high * (1 + give) and byte <= band.bytes + give and entropy >= least


def _figures(block: Block, path: str, bands: dict[str, Band]) -> tuple:
    """The columns of ``measure`` after doc_id."""
    processor, is_byte = _processor(path)
    parts = Parts(block, whole=False)
    distinct, which = parts.distinct()
    encoded = processor.encode([w.decode("utf-8", "replace") for w in distinct])
    size = np.array([len(x) for x in encoded], np.int64)
    flat = np.array([i for x in encoded for i in x], np.int64)
    start = np.cumsum(np.append(0, size))[:-1]
    n = size[which] if len(which) else size
    ids = flat[spread(start[which], n)] if len(which) else flat
    first = np.cumsum(np.append(0, n))[parts.first]
    tokens, words = np.diff(first), np.diff(parts.first)
    chars = row_sums(((block.data & 0xC0) != 0x80) & ~SPACE[block.data], block.at)
    symbols = row_sums(_SYMBOL[block.data], block.at)
    repeats = row_sums(repeated_windows(parts.hashes, parts.first), parts.first)
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * words)
    per = chars / np.maximum(tokens, 1)
    byte = row_sums(is_byte[ids], first) / np.maximum(tokens, 1)
    entropy = _entropy(ids, first)
    lines = [_repeated_lines(block.raw(i)) for i in range(len(block))]
    names = [lang if lang in bands else script(block.raw(i)) for i, lang in enumerate(block.rows["_lang"].to_pylist())]
    kept = [
        not f and (name not in bands or within(bands[name], *x))
        for f, name, *x in zip(failed.tolist(), names, tokens.tolist(), per.tolist(), byte.tolist(), entropy.tolist())
    ]
    return words, chars, symbols, lines, repeats, failed, tokens, per, byte, entropy, names, kept


def _language(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def measure(docs: DataFrame, path: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """One row for each row of ``docs`` with its counts, fertility figures, band and verdict."""
    bands = BANDS if bands is None else bands
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("n_tokens", pa.int64())]
        + [(n, pa.float64()) for n in ("chars_per_token", "byte_share", "entropy")]
        + [("band", pa.string()), ("kept", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            yield batch(schema, block.rows["doc_id"], *_figures(block, path, bands))

    return texts(docs, _language(docs).alias("_lang")).mapInArrow(run, _FIELDS)


def keep(docs: DataFrame, path: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and without a shuffle."""
    bands = BANDS if bands is None else bands
    width = len(docs.columns)
    whole = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(docs.columns)])
    own = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    lang = F.col(own["lang"]).cast("string") if "lang" in own else F.lit(None).cast("string")
    text = F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))
    rows = whole.withColumns({"_lang": lang, "_text": text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK, column="_text"):
            passed = pa.array(_figures(block, path, bands)[-1], pa.bool_())
            yield block.rows.select(list(range(width))).filter(passed)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    kept = rows.mapInArrow(run, types)
    return kept.select(*[F.col(c).alias(n) for n, c in own.items()])
