"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of words given the word before, of words alone,
and a uniform share for unknown words. The weights of the mixture depend on how often the
context was seen, in buckets by powers of two, and are learned by expectation-maximisation on
counts from a fold of the training texts that the estimates for this step leave out. Scores
then use the estimates from all training texts.

Words go by 64-bit hashes. A task packs its texts into token blocks of about ``BLOCK`` bytes
and the blocks are written once. Each block sends its different words and pairs with their
counts, cut by key range; the ranges add them up and send back to each block nothing but the
totals, in the order the block asked. So a frequent word travels once for each block, not once
for each use, and no text is shuffled. The tables of counts grow with the corpus and are never
brought to the driver; it gets four totals, and one row for each of at most 64 buckets in each
step of the expectation-maximisation.

Null text counts as empty: one end token. Null doc_ids belong to the fold of the empty text.
Repeated rows are texts of their own. An empty table gives no rows. Without training texts
every token has probability one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Parts, batch, blocks, fold_of, mixed, row_sums, texts

BLOCK = 4 << 20
SLICE = 1 << 16
BLOCKS_A_RANGE = 2
ROUNDS = 12
BUCKETS = 64
_END = np.uint64(0xE5D0E5D0E5D0E5D1)
_LEARN, _WEIGH, _SCORE = 0, 1, 2  # use of a text: counts, held-out counts for the weights, neither


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, then compressed: small and sorted numbers take little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class TokenBlock:
    """Texts as indexes into the block's own sorted vocabulary of word hashes."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, uses: np.ndarray):
        self.vocabulary, self.tokens, self.sizes, self.uses = vocabulary, tokens, sizes, uses

    def contexts(self) -> np.ndarray:
        # Every text ends with the end token, so the token before a first word is an end token.
        end = np.searchsorted(self.vocabulary, _END)
        return np.concatenate(([end], self.tokens[:-1])).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the different pairs, their context and word, and each token's pair."""
        n = len(self.vocabulary)
        pairs, which = np.unique(self.contexts() * n + self.tokens, return_inverse=True)
        which = which.astype(np.uint32)
        context, word = (pairs // n).astype(np.uint32), (pairs % n).astype(np.uint32)
        del pairs
        keys = mixed(self.vocabulary[context] * np.uint64(0x9E3779B97F4A7C15) ^ (self.vocabulary[word] >> np.uint64(1)))
        keys = mixed(keys + self.vocabulary[word])
        order = np.argsort(keys)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return keys[order], context[order], word[order], place[which]


_BLOCK_FIELDS = "block long, weigh boolean, docs binary, sizes binary, uses binary, vocabulary binary, tokens binary"


def _token_blocks(docs: DataFrame) -> DataFrame:
    schema = pa.schema(
        [("block", pa.int64()), ("weigh", pa.bool_()),
         *((n, pa.binary()) for n in ("docs", "sizes", "uses", "vocabulary", "tokens"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The blocks are written by this job; a number is used by one task and one attempt of it.
        number = TaskContext.get().partitionId() << 32
        held: dict[bool, list] = {False: [], True: []}

        def flush(weigh: bool) -> pa.RecordBatch:
            nonlocal number
            docs, sizes, uses, hashes = (np.concatenate(x) for x in zip(*held[weigh]))
            held[weigh] = []
            vocabulary, tokens = np.unique(hashes, return_inverse=True)
            number += 1
            row = [_pack(x) for x in (docs, sizes.astype(np.int32), uses.astype(np.int8), vocabulary, tokens.astype(np.uint32))]
            return batch(schema, [number], [weigh], *[[x] for x in row])

        for block in blocks(batches, limit=BLOCK // 8):
            parts = Parts(block, whole=False, lower=True)
            rows = np.arange(len(block))
            tokens = np.full(len(parts) + len(block), _END, np.uint64)
            row_of = np.repeat(rows, np.diff(parts.first))
            tokens[np.arange(len(parts)) + row_of] = parts.hashes
            sizes = np.diff(parts.first) + 1
            uses = block.rows["use"].to_numpy()
            missing = np.iinfo(np.int64).min
            docs = np.array([missing if d is None else d for d in block.rows["doc_id"].to_pylist()], np.int64)
            for weigh in (False, True):
                mine = (uses == _WEIGH) == weigh
                if mine.any():
                    held[weigh].append((docs[mine], sizes[mine], uses[mine], tokens[np.repeat(mine, sizes)]))
                    if sum(len(x[3]) for x in held[weigh]) * 6 >= BLOCK:
                        yield flush(weigh)
        for weigh in (False, True):
            if held[weigh]:
                yield flush(weigh)

    return docs.mapInArrow(run, _BLOCK_FIELDS)


def _read(rows: pa.RecordBatch, i: int) -> TokenBlock:
    kinds = {"vocabulary": np.uint64, "tokens": np.uint32, "sizes": np.int32, "uses": np.int8}
    return TokenBlock(*(_unpack(rows[n][i].as_py(), k) for n, k in kinds.items()))


_ASK = "part long, block long, weigh boolean, pair boolean, keys binary, counts binary"


def _ask(table: DataFrame, parts: int) -> DataFrame:
    """Each block's different words and pairs with their training counts, by key range."""
    schema = pa.schema(
        [("part", pa.int64()), ("block", pa.int64()), ("weigh", pa.bool_()), ("pair", pa.bool_()),
         ("keys", pa.binary()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                own = _read(rows, i)
                train = np.repeat(own.uses != _SCORE, own.sizes)
                keys, _, _, which = own.pairs()
                for pair, key, at in ((False, own.vocabulary, own.tokens), (True, keys, which)):
                    counts = np.bincount(at[train], minlength=len(key)).astype(np.uint32)
                    part = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    last = np.append(first[1:], len(part))
                    n = len(first)
                    yield batch(
                        schema, part[first], [rows["block"][i].as_py()] * n, [rows["weigh"][i].as_py()] * n, [pair] * n,
                        [_pack(key[s:e]) for s, e in zip(first, last)], [_pack(counts[s:e]) for s, e in zip(first, last)],
                    )

    return table.mapInArrow(run, _ASK)


_TOLD = "part long, block long, weigh boolean, pair boolean, learned binary, total binary, words long, known long, words_learned long, known_learned long"


def _add_up(asked: DataFrame) -> DataFrame:
    """For every request the counts over all blocks, and in a row without block the totals of words."""
    schema = pa.schema(
        [("part", pa.int64()), ("block", pa.int64()), ("weigh", pa.bool_()), ("pair", pa.bool_()),
         ("learned", pa.binary()), ("total", pa.binary()),
         *((n, pa.int64()) for n in ("words", "known", "words_learned", "known_learned"))]
    )

    def settle(part: int, pair: bool, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [_unpack(r[2], np.uint64) for r in rows]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack(r[3], np.uint32) for r in rows]).astype(np.float64)
        weigh = np.repeat([r[1] for r in rows], [len(k) for k in keys])
        learned = np.bincount(which, np.where(weigh, 0, counts), len(distinct)).astype(np.int64)
        total = np.bincount(which, counts, len(distinct)).astype(np.int64)
        at = np.cumsum([0, *map(len, keys)])
        if not pair:
            sums = [[int(x)] for x in (total.sum(), (total > 0).sum(), learned.sum(), (learned > 0).sum())]
            yield batch(schema, [part], [None], [None], [pair], [None], [None], *sums)
        for r, s, e in zip(rows, at[:-1], at[1:]):
            mine = which[s:e]
            told = [_pack(learned[mine]) if r[1] else None, _pack(total[mine])]
            yield batch(schema, [part], [r[0]], [r[1]], [pair], [told[0]], [told[1]], *[[None]] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for rows in batches:
            names = ("part", "pair", "block", "weigh", "keys", "counts")
            for part, pair, *rest in zip(*(rows[n].to_pylist() for n in names)):
                if (part, pair) != now:
                    if held:
                        yield from settle(*now, held)
                    now, held = (part, pair), []
                held.append(tuple(rest))
        if held:
            yield from settle(*now, held)

    placed = asked.repartition("part").sortWithinPartitions("part", "pair", "block")
    return placed.mapInArrow(run, _TOLD)


def _answered(table: DataFrame, told: DataFrame, column: str) -> DataFrame:
    """Token blocks and the answers to them, a block followed by its answers in order of request.

    ``column``: ``learned`` or ``total``, the counts that are sent.
    """
    names = ["docs", "sizes", "uses", "vocabulary", "tokens"]
    asks = table.select("block", F.lit(False).alias("pair"), F.lit(-1).cast("long").alias("part"), *names,
                        F.lit(None).cast("binary").alias("answer"))
    answers = told.select("block", "pair", "part", *[F.lit(None).cast("binary").alias(n) for n in names], F.col(column).alias("answer"))
    return asks.union(answers).repartition("block").sortWithinPartitions("block", "pair", "part")


def _block_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each token block with its doc_ids and the counts of its words and of its pairs."""
    now = None
    for rows in batches:
        for i in range(rows.num_rows):
            if rows["part"][i].as_py() < 0:
                if now:
                    yield now[0], now[1], *(np.concatenate(x) for x in now[2])
                    now = None
                now = _unpack(rows["docs"][i].as_py(), np.int64), _read(rows, i), ([], [])
            else:
                now[2][rows["pair"][i].as_py()].append(_unpack(rows["answer"][i].as_py(), np.int64))
    if now:
        yield now[0], now[1], *(np.concatenate(x) for x in now[2])


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of log2 of its count."""
    return np.frexp(count.astype(np.float64))[1]


def _held_out(answered: DataFrame) -> DataFrame:
    """Different ``pair, context, word`` counts of held-out tokens and how many tokens have them."""
    schema = pa.schema([(n, pa.int64()) for n in ("pair", "context", "word", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, word_counts, pair_counts in _block_answers(batches):
            _, context, word, which = own.pairs()
            rows = np.stack([pair_counts, word_counts[context], word_counts[word]], axis=1)
            weight = np.bincount(which, minlength=len(rows))
            order = np.lexsort(rows.T)
            rows = rows[order]
            first = np.flatnonzero(np.append(True, np.any(rows[1:] != rows[:-1], axis=1)))
            yield batch(schema, *rows[first].T, np.add.reduceat(weight[order], first))

    told = answered.mapInArrow(run, "pair long, context long, word long, n long")
    return told.groupBy("pair", "context", "word").agg(F.sum("n").alias("n"))


def learn_weights(events: DataFrame, words: int, known: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and uniform estimates for each bucket of context counts.

    ``events``: pair, context, word counts among the learned texts, and ``n`` held-out tokens.
    """
    slot = F.when(F.col("context") > 0, F.floor(F.log2(F.col("context"))) + 1).otherwise(0)
    p2 = F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
    table = cut(
        events.select(slot.cast("int").alias("slot"), p2.alias("p2"), (F.col("word") / max(1, words)).alias("p1"), "n")
    )
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for _ in range(rounds):
        share = [F.element_at(F.array(*map(F.lit, map(float, weights[:, k]))), F.col("slot") + 1) for k in range(3)]
        terms = [share[0] * F.col("p2"), share[1] * F.col("p1"), share[2] * F.lit(1.0 / (known + 1))]
        mix = table.select("slot", "n", *[t.alias(f"t{k}") for k, t in enumerate(terms)])
        scale = F.col("n") / (F.col("t0") + F.col("t1") + F.col("t2"))
        got = mix.groupBy("slot").agg(*[F.sum(F.col(f"t{k}") * scale).alias(f"s{k}") for k in range(3)]).collect()
        new = weights.copy()
        for row in got:  # at most one row for each bucket
            sums = np.array([row.s0, row.s1, row.s2]) + np.array([1e-3 if row.slot else 0, 1e-3, 1e-3])
            new[row.slot] = sums / sums.sum()
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-4:
            break
    return weights


def _scores(answered: DataFrame, weights: np.ndarray, words: int, known: int) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, own, word_counts, pair_counts in _block_answers(batches):
            _, context, word, which = own.pairs()
            logs = np.zeros(len(context))
            for at in range(0, len(context) if words else 0, SLICE):  # a few arrays of a slice, not of all pairs
                some = slice(at, at + SLICE)
                seen, count = word_counts[context[some]], word_counts[word[some]]
                mix = weights[bucket(seen)]
                p = mix[:, 0] * pair_counts[some] / np.maximum(seen, 1) + mix[:, 1] * count / words + mix[:, 2] / (known + 1)
                logs[some] = np.log10(np.minimum(p, 1.0))
            del context, word, pair_counts
            score = logs[which]
            base = np.log10((word_counts + 1) / (words + known + 1))[own.tokens]
            first = np.cumsum(np.append(0, own.sizes))
            ids = pa.array(docs, mask=docs == np.iinfo(np.int64).min)
            yield batch(
                schema, ids, own.uses == _SCORE, own.sizes, row_sums((word_counts > 0)[own.tokens], first),
                np.full(len(docs), words), np.add.reduceat(base, first[:-1]), np.add.reduceat(score, first[:-1]),
            )

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.mapInArrow(run, fields)


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, weigh: int = 6, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``; the model learns from all folds but ``held_out``.

    Fold ``weigh`` of the training texts gives the counts the weights are learned on.
    """
    fold = fold_of(folds)
    use = F.when(fold == held_out, _SCORE).when(fold == weigh, _WEIGH).otherwise(_LEARN)
    table = cut(_token_blocks(texts(docs, use.cast("int").alias("use"))))
    parts = max(1, table.count() // BLOCKS_A_RANGE)  # key ranges grow with the blocks
    told = cut(_add_up(_ask(table, parts)))
    names = ("words", "known", "words_learned", "known_learned")
    totals = told.filter("block IS NULL").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    told = told.filter("block IS NOT NULL")
    weigh_blocks = _answered(table.filter("weigh"), told.filter("weigh"), "learned")
    weights = learn_weights(_held_out(weigh_blocks), totals.words_learned, totals.known_learned, rounds)
    return _scores(_answered(table, told, "total"), weights, totals.words, totals.known)
