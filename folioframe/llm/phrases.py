"""Collocations of each language, counted in direct-address tiles.

Texts become blocks of about ``BLOCK`` bytes of one language. A block is written once, as its
different words and its text as indexes into them. Words that occur ``least`` times in their
language get ids by frequency, and each block is sent the ids of its own words. Neighbouring
frequent words are pairs of ids; a pair lies in the tile ``(first // TILE, second // TILE)``, and
each tile is counted for itself: one with many entries for its cells in a dense array that is
addressed by the pair and filled by bincount, a sparse one as sorted coordinates with counts.
Blocks count first, so a tile gets at most one row of a pair from a block, and a task goes
through the rows of a tile in bounded pieces. The frequent pairs are ranked by frequency
in turn and each block is sent the ranks of its own pairs; a phrase of one more word is a pair of
a frequent phrase and a word, counted in the same way. A longer phrase can only be frequent when both
phrases of one word less in it are, so nothing else is counted.

No count of the corpus is broadcast or brought to the driver; a filter of ``FILTER_BITS`` bits is, which
tells a block which of its pairs can be frequent and so need to ask for a rank (pairs that share a
bit ask in vain, so a full filter costs shuffles and no result). A frequent word travels once
for each block that has it. A language with a third of all rows is many blocks and tiles.
Words and pairs are compared themselves, never by hashes. A text longer than a block is cut at
a white space or a separator, and the cut carries the words before it, so memory is bounded
for any text with a white space now and then.

Null texts count as empty, a null language as ``und``. Repeated rows are texts of their own. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import scan
from ..session import cut
from .blocks import batch, blocks, mixed
from .lm_score import _pack, _unpack

BLOCK = 4 << 20
TILE = 1 << 8
PIECE = 1 << 20  # entries of a tile that are held at a time
FILTER_BITS = 1 << 27  # of the filter of frequent pairs, 16 MB whatever the corpus
ROWS = 1 << 16  # of a batch that a task returns
_DENSE = 16  # a tile with an entry for so many cells is counted in a dense array
_SHIFT = 32  # a pair of ids as one number
_LOW = (1 << _SHIFT) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)

# Separators of pieces become a full stop, a tab a blank, A-Z lower case.
_CLEAN = bytes(
    ord(".") if b in b".,;:!?\n\v\f\r" else ord(" ") if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)
_STOP = b"."


def words(clean: bytes) -> list[bytes]:
    """Words of cleaned text, with a full stop for each separator."""
    return clean.replace(_STOP, b" . ").split()


def slices(clean: bytes, limit: int, context: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts, each with the number of words at its start that the part before has."""
    start, before = 0, []
    while start < len(clean):
        end = min(start + limit, len(clean))
        if end < len(clean):
            cuts = [p for p in (clean.rfind(b" ", start, end), clean.rfind(_STOP, start, end)) if p > start]
            later = [p for p in (clean.find(b" ", end), clean.find(_STOP, end)) if p >= 0]
            end = max(cuts) if cuts else min(later, default=len(clean))
        part = b" ".join([*before, clean[start:end]])
        yield part, len(before)
        if end < len(clean):
            # The last words of the piece that the cut went through.
            before = part.rpartition(_STOP)[2].split()[-context:] if context else []
        start = end


_BLOCKS = "block long, lang string, words array<binary>, uses array<long>, which binary, repeated array<int>"


def _word_blocks(docs: DataFrame, context: int, limit: int) -> DataFrame:
    schema = pa.schema(
        [("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("uses", pa.list_(pa.int64())),
         ("which", pa.binary()), ("repeated", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The blocks are written by this job; a number is used by one task and one attempt of it.
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}  # of each language: texts with their repeated words, and bytes

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            found, repeated = [], []
            for text, again in held.pop(lang)[0]:
                repeated += range(len(found), len(found) + again)
                found += words(text)
                found.append(_STOP)
            tokens = pa.array(found, pa.binary()).dictionary_encode()
            which = tokens.indices.to_numpy().astype(np.int32)
            raw = tokens.dictionary.to_pylist()
            uses = np.bincount(which, minlength=len(raw)) - np.bincount(which[repeated], minlength=len(raw))
            stop = raw.index(_STOP)
            which[which == stop] = -1
            uses[stop] = 0
            return batch(schema, [number], [lang], [raw], [uses], [_pack(which)], [repeated])

        def add(lang: str, text: bytes, again: int) -> Iterator[pa.RecordBatch]:
            mine = held.setdefault(lang, [[], 0])
            mine[0].append((text, again))
            mine[1] += len(text) + 1
            if mine[1] >= limit:
                yield flush(lang)
            elif sum(h[1] for h in held.values()) >= 4 * limit:
                yield flush(max(held, key=lambda name: held[name][1]))

        for block in blocks(batches):
            clean = block.data.tobytes().translate(_CLEAN)
            at = block.at.tolist()
            for lang, a, b in zip(block.rows["lang"].to_pylist(), at, at[1:]):
                for text, again in slices(clean[a:b], limit, context):
                    yield from add(lang, text, again)
        for lang in list(held):
            yield flush(lang)

    return docs.mapInArrow(run, _BLOCKS)


def count_codes(codes: np.ndarray, uses: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of one tile with the sum of their uses: dense where there are many."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    low = ((codes >> _SHIFT) // TILE * TILE << _SHIFT) | ((codes & _LOW) // TILE * TILE)
    cell = (((codes >> _SHIFT) % TILE) * TILE) + (codes & _LOW) % TILE
    if len(codes) * _DENSE >= TILE * TILE:
        # Sums stay below 2**53, so the doubles of bincount are exact.
        dense = np.bincount(cell, uses, TILE * TILE) if uses is not None else np.bincount(cell, minlength=TILE * TILE)
        found = np.flatnonzero(dense)
        return low[0] + ((found // TILE) << _SHIFT) + found % TILE, dense[found].astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    ones = np.ones(len(codes), np.int64) if uses is None else uses[order]
    return codes[starts], np.add.reduceat(ones, starts)


def tile_of(codes: np.ndarray) -> np.ndarray:
    return ((codes >> _SHIFT) // TILE << _SHIFT) | ((codes & _LOW) // TILE)


def count_all(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes with their number, tile by tile where tiles are dense."""
    tiles, sizes = np.unique(tile_of(codes), return_counts=True)
    dense = tiles[sizes * _DENSE >= TILE * TILE]
    out, rest = [], np.ones(len(codes), bool)
    of = tile_of(codes)
    for tile in dense:
        mine = of == tile
        rest &= ~mine
        out.append(count_codes(codes[mine]))
    out.append(np.unique(codes[rest], return_counts=True))
    return np.concatenate([c for c, _ in out]), np.concatenate([n for _, n in out]).astype(np.int64)


_STEP = "block long, lang string, codes array<long>, uses array<long>, which binary, repeated array<int>"


def _step(held: DataFrame, ids: DataFrame, length: int, last: bool) -> DataFrame:
    """Blocks with their phrases of ``length`` words as codes, from ``ids(block, idx, id)`` of what
    ``which`` points to: the frequent phrase of one word less that starts at each place."""
    schema = pa.schema(
        [("block", pa.int64()), ("lang", pa.string()), ("codes", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64())),
         ("which", pa.binary()), ("repeated", pa.list_(pa.int32()))]
    )

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        which = _unpack(left["which"][0].as_py(), np.int32)
        of = np.full(int(which.max(initial=-1)) + 2, -1, np.int64)
        idx = right["idx"].to_numpy()
        inside = idx < len(of) - 1
        of[idx[inside]] = right["id"].to_numpy()[inside]
        head = of[which]  # the last entry stands for -1
        if length == 2:
            word = head
        else:  # the last word of the phrase at each place
            codes = np.append(left["codes"].combine_chunks().flatten().to_numpy(), 0)
            word = np.where(head >= 0, codes[which] & _LOW, -1)
        # A longer phrase takes the phrase at a place and the last word of the one behind it.
        good = (head[:-1] >= 0) & (word[1:] >= 0)
        codes = ((head[:-1] << _SHIFT) | word[1:])[good]
        different, index = np.unique(codes, return_inverse=True)
        repeated = left["repeated"][0].as_py()
        fresh = np.ones(len(which) + length, bool)
        fresh[repeated] = False
        # A phrase belongs to the part that has its last word for the first time.
        counted, sums = count_all(codes[fresh[length - 1 : length - 1 + len(good)][good]])
        uses = np.zeros(len(different), np.int64)
        uses[np.searchsorted(different, counted)] = sums
        if last:
            which = b""
        else:
            places = np.full(len(which), -1, np.int32)
            places[:-1][good] = index
            which = _pack(places)
        columns = [left["block"].to_pylist(), left["lang"].to_pylist(), [different], [uses], [which], [repeated]]
        return pa.Table.from_batches([batch(schema, *columns)])

    ids = ids.withColumnRenamed("block", "of")  # both come from the same blocks
    return held.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(task, _STEP)


def _bits(langs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each pair in the filter."""
    return (mixed(codes.astype(np.uint64) + langs.astype(np.uint64) * _ODD) % np.uint64(FILTER_BITS)).astype(np.int64)


def _lang_number(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bit for each frequent pair, others may share it. The driver gets ``FILTER_BITS`` and no more:
    the distinct bits come combined into bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bit", pa.int64())])
        for rows in batches:
            langs = rows["lang"].dictionary_encode()
            numbers = np.array([_lang_number(x) for x in langs.dictionary.to_pylist()], np.uint64)
            yield batch(schema, _bits(numbers[langs.indices.to_numpy()], rows["code"].to_numpy()))

    bits = frequent.select("lang", "code").mapInArrow(run, "bit long")
    bits = bits.select(F.floor(F.col("bit") / 64).alias("word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


_ENTRY = "block long, lang string, idx int, code long, uses long"


def _entries(held: DataFrame, chosen: Broadcast | None = None) -> DataFrame:
    """A row for each different phrase of a block: those used in it, or those the filter knows."""
    schema = pa.schema(
        [("block", pa.int64()), ("lang", pa.string()), ("idx", pa.int32()), ("code", pa.int64()), ("uses", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                block, lang = rows["block"][i].as_py(), rows["lang"][i].as_py()
                codes = rows["codes"][i].values.to_numpy()
                uses = rows["uses"][i].values.to_numpy()
                if chosen is None:
                    idx = np.flatnonzero(uses)
                else:
                    bit = _bits(np.array([_lang_number(lang)], np.uint64), codes)
                    idx = np.flatnonzero(chosen.value[bit // 64] >> (bit % 64) & 1)
                for at in range(0, len(idx), ROWS):
                    some = idx[at : at + ROWS]
                    n = len(some)
                    yield batch(schema, np.full(n, block), pa.array([lang]).take(pa.array(np.zeros(n, np.int8))), some, codes[some], uses[some])

    return held.select("block", "lang", "codes", "uses").mapInArrow(run, _ENTRY)


def _tile_counts(rows: DataFrame, least: int) -> DataFrame:
    """Codes of a language with ``least`` uses and more, from ``rows(lang, code, uses)``."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, uses, size = None, [], [], 0
        done: list[tuple[str, np.ndarray, np.ndarray]] = []

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            return count_codes(np.concatenate(codes), np.concatenate(uses))

        def finish() -> int:
            found, total = add_up()
            good = total >= least
            done.append((key[0], found[good], total[good]))
            return int(good.sum())

        def give() -> pa.RecordBatch:
            langs = np.repeat([lang for lang, _, _ in done], [len(c) for _, c, _ in done])
            out = batch(schema, pa.array(langs.tolist(), pa.string()), *(np.concatenate([d[i] for d in done]) for i in (1, 2)))
            done.clear()
            return out

        ready = 0
        for rows in batches:
            code, use = rows["code"].to_numpy(), rows["uses"].to_numpy()
            lang = rows["lang"].dictionary_encode()
            tile, number = tile_of(code), lang.indices.to_numpy()
            borders = (np.flatnonzero((np.diff(tile) != 0) | (np.diff(number) != 0)) + 1).tolist()
            for a, b in zip([0, *borders], [*borders, len(code)]):
                if a == b:
                    continue
                here = lang.dictionary[int(number[a])].as_py(), int(tile[a])
                if key is not None and here != key:
                    ready += finish()
                    codes, uses, size = [], [], 0
                key = here
                codes.append(code[a:b])
                uses.append(use[a:b])
                size += b - a
                if size >= PIECE:  # at most as many are left as a tile has cells
                    found, total = add_up()
                    codes, uses, size = [found], [total], 0
            if ready >= ROWS or len(done) >= ROWS:
                yield give()
                ready = 0
        if key is not None:
            finish()
            yield give()
        pa.default_memory_pool().release_unused()

    first, second = F.shiftright("code", _SHIFT), F.col("code").bitwiseAND(F.lit(_LOW))
    tile = F.shiftleft(F.floor(first / TILE), _SHIFT).bitwiseOR(F.floor(second / TILE))
    tiles = rows.select("lang", "code", "uses").repartition("lang", tile).sortWithinPartitions("lang", tile)
    return tiles.mapInArrow(run, "lang string, code long, a long")


def _ranked(counts: DataFrame, by: str) -> DataFrame:
    """Ids from 0 in each language, the most frequent first."""
    ranked = scan.rank(counts, ["lang"], [F.desc("a"), by], "id")
    return cut(ranked.withColumn("id", F.col("id") - 1))


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, limit: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases ``(lang, words, a, head, tail)`` of 2 to ``longest`` words, where head and
    tail have one word less, and words ``(lang, word, a)`` with the sum ``n`` of their language."""
    texts = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )
    held = cut(_word_blocks(texts, longest - 1, limit))
    named = held.select("block", "lang", F.posexplode(F.arrays_zip("words", "uses")).alias("idx", "w"))
    counts = named.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.uses").alias("a")).filter("a > 0")
    counts = cut(counts)
    sums = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    vocabulary = _ranked(counts.filter(F.col("a") >= least), "word")
    ids = named.select("block", "lang", "idx", F.col("w.words").alias("word"))
    ids = ids.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("block"), "idx", "id")
    shorter = vocabulary.select("lang", "id", F.array(F.col("word").cast("string")).alias("words"), "a")
    single = vocabulary.select("lang", F.col("id").alias("_second"), F.col("word").cast("string").alias("_word"))
    out = []
    for length in range(2, longest + 1):
        held = held.drop("words", "uses")
        held = cut(_step(held, ids, length, length == longest))
        frequent = _ranked(cut(_tile_counts(_entries(held).select("lang", "code", "uses"), least)), "code")
        if length < longest:
            # Most pairs of a corpus are rare: a filter of fixed size spares them the way to the ranks.
            chosen = docs.sparkSession.sparkContext.broadcast(_filter(frequent))
            asked = _entries(held, chosen).drop("uses")
            ids = asked.join(frequent.select("lang", "code", "id"), ["lang", "code"]).select(F.col("block").alias("block"), "idx", "id")
        parts = frequent.select(
            "*",
            F.shiftright("code", _SHIFT).alias("_first"),
            F.col("code").bitwiseAND(F.lit(_LOW)).alias("_second"),
        )
        before = shorter.select("lang", F.col("id").alias("_first"), F.col("words").alias("head"))
        named_phrases = parts.join(before, ["lang", "_first"]).join(single, ["lang", "_second"])
        shorter = cut(
            named_phrases.select("lang", "id", F.concat("head", F.array("_word")).alias("words"), "a")
        )
        out.append(shorter.select("lang", "words", "a"))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every, vocabulary.select("lang", F.array(F.col("word").cast("string")).alias("words"), "a").join(sums, "lang")


def _big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(15,0)")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, limit: int = BLOCK
) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    A phrase goes when one word more makes a candidate with ``share`` per cent of its count; every
    longer candidate around it has no more, so those need no look.
    """
    found, single = phrases(docs, longest, least, limit)
    sums = single.select("lang", "n").distinct()
    parts = found.select("lang", "words", "a").union(single.select("lang", "words", "a"))
    cuts = found.select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).select(
        "*",
        F.slice("words", F.lit(1), F.col("k")).alias("_left"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("_right"),
    )
    cuts = cuts.join(parts.select("lang", F.col("words").alias("_left"), F.col("a").alias("l")), ["lang", "_left"])
    cuts = cuts.join(parts.select("lang", F.col("words").alias("_right"), F.col("a").alias("r")), ["lang", "_right"])
    # Counts below 10**15 keep every product within the 38 digits of a decimal; a <= l, r.
    score = F.expr("CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * 1000000 DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    cuts = cuts.withColumn("score", score)
    lowest = F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k"))
    scored = cuts.groupBy("lang", "words").agg(lowest.alias("c")).select("lang", "words", "c.*")
    inner = found.filter(F.size("words") > 2).select(
        "lang",
        F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words"),
        "a",
    )
    inner = inner.groupBy("lang", "words").agg(F.max("a").alias("_longer"))
    kept = scored.join(inner, ["lang", "words"], "left").filter(
        F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))
    )
    kept = kept.withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(sums, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
