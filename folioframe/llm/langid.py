"""Language of a text by a string kernel, Nyström landmarks and ridge regression.

The kernel of two texts is the number of byte n-grams (n from 1 to 3, after lower-casing) that
occur in both, each counted once, divided by the root of the two texts' own numbers. Only
n-grams of the landmarks count, so a text is its presence vector over these. A kernel ridge
regression, one language against the rest, is fitted in the space of the Nyström landmarks.
Kernel values with the landmarks are linear in the presence vector, so a batch of texts is
scored by one matrix product.

The fit uses a bounded sample of labelled rows: at most ``FIT`` texts for each language and
``LANGUAGES`` languages (the most frequent), texts of at most ``FIT_BYTES`` bytes, drawn by a
hash of the doc_id. Everything else sees whole texts of all rows, without a shuffle.

A null text or one without letters is ``und`` with score 0, and so is every text if nothing can
be learned. Null doc_ids belong to the fold of the empty text. Ties go to the language that
sorts first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, batch, blocks, fold_of, text_column

FIT, LANGUAGES, FIT_BYTES = 240, 128, 1 << 16
LANDMARKS, NGRAMS = 48, 1 << 14  # for each language; in all
RIDGE = 1e-2
_ROWS = 64  # texts in one matrix product
_LETTER = regex.compile(r"\p{L}")
# Codes of n-grams of one, two and three bytes lie one after the other.
_BASE = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
_CODES = (1 << 8) + (1 << 16) + (1 << 24)


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """Code of the n-gram from each place."""
    x = data.astype(np.int32)
    code = x[: max(0, len(x) - n + 1)]
    for i in range(1, n):
        code = code << 8 | x[i : len(x) - n + 1 + i]
    return code + _BASE[n]


def presence(texts: list[bytes], index: np.ndarray, width: int) -> np.ndarray:
    """Matrix of ones where a text has an n-gram; ``index`` maps codes to columns, or -1."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts):
        data = np.frombuffer(text, np.uint8)
        for n in _BASE:
            at = index[codes(data, n)]
            row[at[at >= 0]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    ngrams: np.ndarray  # codes, in the order of the columns
    weights: np.ndarray  # n-grams x languages

    def index(self) -> np.ndarray:
        out = np.full(_CODES, -1, np.int16)
        out[self.ngrams] = np.arange(len(self.ngrams))
        return out

    def scores(self, texts: list[bytes], index: np.ndarray) -> np.ndarray:
        x = presence(texts, index, len(self.ngrams))
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def fit(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ngrams: int = NGRAMS) -> Model | None:
    """Kernel ridge regression on lower-cased UTF-8 texts; the landmarks are the first of each language."""
    if not texts:
        return None
    languages = sorted(set(labels))
    own = [i for lang in languages for i in [k for k, x in enumerate(labels) if x == lang][:landmarks]]
    seen: dict[int, int] = {}
    for i in own:
        data = np.frombuffer(texts[i], np.uint8)
        for code in np.unique(np.concatenate([codes(data, n) for n in _BASE])).tolist():
            seen[code] = seen.get(code, 0) + 1
    chosen = np.array(sorted(sorted(seen), key=lambda c: -seen[c])[:ngrams], np.int64)
    model = Model(languages, chosen, np.zeros((len(chosen), 0), np.float32))
    index = model.index()
    x = presence(texts, index, len(chosen))
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    marks = x[own]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    to_space = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T) @ to_space
    target = np.array([[float(label == lang) for lang in languages] for label in labels])
    # Each language weighs the same, however many rows it has.
    weight = (1 / target.sum(axis=0))[[languages.index(x) for x in labels]] * len(labels) / len(languages)
    solved = np.linalg.solve(z.T @ (z * weight[:, None]) + RIDGE * np.eye(z.shape[1]), z.T @ (target * weight[:, None]))
    model.weights = (marks.T @ (to_space @ solved)).astype(np.float32)
    return model


def lower(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").lower().encode()


def sample(docs: DataFrame, folds: int, held_out: int) -> tuple[list[bytes], list[str]]:
    """The bounded sample that the model is fitted on."""
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(fold_of(folds) != held_out)
    text, lang = text_column(), F.col("lang").cast("string")
    usable = usable.select(text.alias("text"), lang.alias("lang"), F.xxhash64("doc_id").alias("draw"))
    usable = usable.filter((F.octet_length("text") <= FIT_BYTES) & (F.octet_length("text") > 0))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], []
    # About twice the number wanted, by hash, so that no language is sorted as a whole.
    size = 1 << 20
    share = F.lit(-1)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], min(size, 2 * FIT * size // row["count"] + 1)).otherwise(share)
    # Rows of one repeated id are drawn together, so the number is limited before it comes to the driver.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    drawn = usable.filter(F.pmod("draw", F.lit(size)) < share).withColumn("place", place).filter(F.col("place") <= FIT)
    drawn = drawn.select("lang", "text", "draw").collect()
    drawn.sort(key=lambda r: (r.lang, r.draw, r.text))
    texts, labels = [], []
    for row in counts:
        for r in [r for r in drawn if r.lang == row["lang"]][:FIT]:
            texts.append(lower(r.text.encode()))
            labels.append(r.lang)
    return texts, labels


def predict(docs: DataFrame, model: Model | None, folds: int, held_out: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )
    fields = "doc_id long, held_out boolean, lang_pred string, score double"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), (fold_of(folds) == held_out).alias("held_out")
    )
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most NGRAMS x LANGUAGES numbers

    def label(block: Block, own: Model, index: np.ndarray) -> tuple[list[str], np.ndarray]:
        texts = [lower(block.raw(i)) for i in range(len(block))]
        scores = own.scores(texts, index)
        best = scores.argmax(axis=1)
        score = np.clip(scores[np.arange(len(best)), best], 0, 1).astype(np.float64)
        lettered = np.array([_LETTER.search(t.decode()) is not None for t in texts])
        names = [own.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = own.index()
        for rows in batches:
            pieces = (rows.slice(at, _ROWS) for at in range(0, rows.num_rows, _ROWS))
            for block in blocks(pieces, limit=8 << 20):
                names, score = label(block, own, index)
                yield batch(schema, block.rows["doc_id"], block.rows["held_out"], names, score)

    return rows.mapInArrow(run, fields)


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Fits on the folds other than ``held_out`` and labels every row."""
    return predict(docs, fit(*sample(docs, folds, held_out)), folds, held_out)
