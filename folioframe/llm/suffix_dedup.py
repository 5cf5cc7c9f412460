"""Removal of long repeated byte strings, by suffix arrays over content-defined strips.

A string of ``length`` bytes is judged by itself: it repeats if it also starts elsewhere.
Sorting every suffix of a corpus would shuffle it many times over, so the suffixes are first
dealt into groups that must hold all copies of a string: the group of a string is the least
hash among the short grams inside it (its anchor). Consecutive strings with one anchor form a
strip, about one for every ``length / 2`` bytes.

1. Anchors and a digest of each strip; no text is shuffled.
2. Strips with the same digest are copies: every string in them repeats, and one of them stands
   for all. A group with one kind of strip is settled.
3. Groups with several kinds: the strips themselves go to the group's task, which sorts their
   suffixes to a depth of ``length`` bytes. Rows of the suffix array that agree to that depth
   form runs, in text order; the previous smaller position of a suffix is the row above it, and
   the longest previous factor reaches ``length`` exactly if that row is in the same run. The
   next smaller position lies outside the run and shares less. Later matches likewise, below.
4. A group with more than ``GROUP`` kinds of strip is not gathered. Copies of a string have their
   anchor at one place in it, so the strips are cut by that place into ``CELLS`` cells, and the bytes
   around the anchor that all strings of a cell hold, most of their length, make a group of their
   own. Steps 2 and 3 follow; what is still large is divided again, down to groups of one string.
   A strip is cut into few pieces each time, and most are settled after the first.

``keep="first"`` removes a string if an earlier copy exists (order: doc_id, then place in the
text; null doc_ids first) and so leaves the first; ``keep="none"`` removes every copy.

Null text counts as empty. Rows that repeat both doc_id and text share one result, and count as
one text for "first" but as two for "none". Overlapping copies count. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Block, Hasher, batch, blocks, flat, spread, texts

LENGTH = 400
GRAM = 32
GROUP = 1024
CELLS = 4  # cells that a large group is divided into, again and again
_SORT_BYTES = 1 << 20  # strips sorted at once


def anchor_places(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each string of a block its start, the place of its anchor, and the hashes of all grams."""
    sizes = np.diff(block.at)
    rows = np.flatnonzero(sizes >= length)
    starts = spread(block.at[rows], sizes[rows] - length + 1)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    hashes = Hasher(block.data).grams(gram)
    window = length - gram + 1
    # The hash above, the place below: the least value is the leftmost least hash.
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(packed) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, window)
    from_left = np.minimum.accumulate(grid, axis=1).ravel()
    from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(from_right[starts], from_left[starts + window - 1])
    return starts, (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def anchors(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each strip of a block: row, first and last string start in the row, anchor hash."""
    starts, place, hashes = anchor_places(block, length, gram)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    last = np.concatenate((first[1:], [len(place)])) - 1
    row = np.searchsorted(block.at, starts[first], "right") - 1
    return row, starts[first] - block.at[row], starts[last] - block.at[row], hashes[place[first]]


def _strips(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("_row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
         ("anchor", pa.int64()), ("digest", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, lo, hi, anchor = anchors(block, length, gram)
            if not len(row):
                continue
            view, at = memoryview(np.ascontiguousarray(block.data)), block.at[row]
            digests = [
                hashlib.blake2b(view[s:e], digest_size=16).digest()
                for s, e in zip((at + lo).tolist(), (at + hi + length).tolist())
            ]
            keys = (block.rows[c].take(pa.array(row)) for c in ("doc_id", "_row"))
            yield batch(schema, *keys, lo, hi, anchor.view(np.int64), digests)

    return docs.mapInArrow(run, "doc_id long, _row long, lo long, hi long, anchor long, digest binary")


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes, and the row where each row's run begins.

    A run is a stretch of suffixes that agree to that depth. Prefix doubling from eight bytes;
    after each step only rows that are still tied are sorted.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(min(8, depth)):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[:n]
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.zeros(n + depth + 1, np.int64)  # beyond the end: less than every suffix
    rank[order] = run + 1
    done = 8
    while done < depth:
        step = min(done, depth - done)
        size = np.diff(np.append(np.flatnonzero(new), n))
        rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(rows):
            break
        places, first = order[rows], run[rows]
        key = first << 32 | rank[places + step]
        by = np.argsort(key)
        key = key[by]
        order[rows] = places[by]
        new[rows] = np.append(True, key[1:] != key[:-1])
        run = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order[rows]] = run[rows] + 1
        done += step
    return order, run


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts``: whether its string begins at an earlier, and at a later start too.

    The rows of a run are put in text order. The previous smaller position of a suffix is then
    the row above it and the previous larger one the row below; the factor they share reaches
    ``length`` within the run, and beyond its ends it does not.
    """
    order, run = suffix_order(data, length)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    listed = wanted[order]
    order, run = order[listed], run[listed]
    same = run[1:] == run[:-1]
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))[: len(order)]
    by = np.argsort(run[tied] << 32 | order[tied])
    order[tied] = order[tied][by]
    earlier, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    earlier[order[1:][same]] = True
    later[order[:-1][same]] = True
    return earlier[starts], later[starts]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _sorted_groups(strips: DataFrame, length: int, first: bool) -> DataFrame:
    """Byte ranges of repeated strings among the strips of each group."""
    schema = pa.schema([("_row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by([("doc_id", "ascending"), ("_row", "ascending"), ("lo", "ascending")])
        place = np.stack([rows[c].to_numpy() for c in ("_row", "lo")])
        new = np.append(True, np.any(place[:, 1:] != place[:, :-1], axis=0))
        rows = rows.filter(pa.array(new))  # a table row that is repeated gives its strips once
        data, at = flat(rows["strip"].combine_chunks())
        count = np.diff(at) - length + 1
        starts = spread(at[:-1], count)
        earlier, later = repeated(data, starts, length)
        strip = np.repeat(np.arange(len(count)), count)
        if first:
            found = earlier
        else:
            found = (earlier | later) & (rows["n"].to_numpy() == 1)[strip]
        # A run must not go on into the next strip: leave a gap of one between strips.
        flags = np.zeros(len(starts) + len(count), bool)
        flags[np.arange(len(starts)) + strip] = found
        s, e = _runs(flags)
        if not len(s):
            return
        begin = np.concatenate(([0], np.cumsum(count + 1)))
        owner = np.searchsorted(begin, s, "right") - 1
        base = rows["lo"].to_numpy()[owner] - begin[owner]
        yield batch(schema, rows["_row"].to_numpy()[owner], s + base, e - 1 + base + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for rows in batches:
            table = pa.Table.from_batches([rows])
            held.append(table)
            size += rows.nbytes
            if size < _SORT_BYTES or not table.num_rows:
                continue
            whole = pa.concat_tables(held)
            anchor = whole["anchor"].to_numpy()
            # Whole groups only, as many as fit; the last one may go on in the next batch.
            borders = np.append(np.flatnonzero(np.diff(anchor)) + 1, 0)
            done = 0
            ends = np.cumsum(np.diff(flat(whole["strip"].combine_chunks())[1]))
            for b in np.sort(borders[borders > 0]).tolist():
                if b == borders[:-1].max() or ends[b - 1] - (ends[done - 1] if done else 0) >= _SORT_BYTES:
                    yield from settle(whole.slice(done, b - done))
                    done = b
            held = [whole.slice(done)]
            size = held[0].nbytes
        if held and (whole := pa.concat_tables(held)).num_rows:
            yield from settle(whole)

    return strips.mapInArrow(run, "_row long, start long, end long")


def _extract(rows: DataFrame, length: int) -> DataFrame:
    """The strips named in ``wanted``, cut out of their texts."""
    names = ["doc_id", "_row", "lo", "n", "anchor", "large", "strip"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            wanted = block.rows["wanted"]
            strips = wanted.flatten()
            row = np.repeat(np.arange(len(block)), np.diff(wanted.offsets.to_numpy()))
            part = {f.name: strips.field(i) for i, f in enumerate(wanted.type.value_type)}
            view = memoryview(np.ascontiguousarray(block.data))
            start = block.at[row] + part["lo"].to_numpy()
            end = block.at[row] + part["hi"].to_numpy() + length
            cuts = [bytes(view[s:e]) for s, e in zip(start.tolist(), end.tolist())]
            keys = [block.rows[c].take(pa.array(row)) for c in ("doc_id", "_row")]
            yield batch(schema, *keys, part["lo"], part["n"], part["anchor"], part["large"], cuts)

    return rows.mapInArrow(run, "doc_id long, _row long, lo long, n long, anchor long, large boolean, strip binary")


def _divided(strips: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Strips cut into pieces: the strings that have their anchor at places of one cell of ``width``.

    Copies of a string have their anchor at one place, so they lie in one cell, and the bytes that all
    strings of the piece have in common are theirs too: ``anchor`` becomes a hash of cell and bytes.
    """
    names = ["doc_id", "_row", "lo", "hi", "n", "anchor", "digest", "strip"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 6 + [pa.binary()] * 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column="strip", limit=1 << 17):
            count = np.diff(block.at) - length + 1
            # All strings of a strip have one anchor: that of the first.
            at = anchor_places(block, length, gram)[1][np.cumsum(count) - count] - block.at[:-1]
            low = (at - count + 1) // width
            size = at // width - low + 1
            row, cell = np.repeat(np.arange(len(block)), size), spread(low, size)
            least, most = cell * width, np.minimum(cell * width + width, length - gram + 1) - 1
            base, lo = block.at[row], np.maximum(at[row] - most, 0)
            hi = np.minimum(at[row] - least, count[row] - 1)
            shared = zip(cell.tolist(), (base + at[row] - least).tolist(), (base + at[row] - most + length).tolist())
            view = memoryview(np.ascontiguousarray(block.data))
            keys = [hashlib.blake2b(view[s:e], digest_size=8, salt=c.to_bytes(8, "little")).digest() for c, s, e in shared]
            cuts = [bytes(view[s:e]) for s, e in zip((base + lo).tolist(), (base + hi + length).tolist())]
            digests = [hashlib.blake2b(c, digest_size=16).digest() for c in cuts]
            own = {c: block.rows[c].take(pa.array(row)) for c in ("doc_id", "_row", "n")}
            start = block.rows["lo"].to_numpy()[row]
            anchor = np.frombuffer(b"".join(keys), np.int64)
            yield batch(schema, own["doc_id"], own["_row"], start + lo, start + hi, own["n"], anchor, digests, cuts)

    return strips.mapInArrow(
        run, "doc_id long, _row long, lo long, hi long, n long, anchor long, digest binary, strip binary"
    )


def _settled_pieces(pieces: DataFrame, length: int, first: bool, group: int) -> tuple[DataFrame, DataFrame]:
    """Byte ranges of pieces that are copies, and of the groups with several kinds of piece one for each
    kind, as strips: what ``repeated_ranges`` does with strips of the first anchors."""
    here = F.struct("doc_id", "_row", "lo")
    kinds = pieces.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("total"), F.min(here).alias("least")
    )
    kinds = cut(kinds)
    copies = pieces.join(kinds.filter("pieces > 1"), ["anchor", "digest"])
    copies = copies.filter(~here.eqNullSafe(F.col("least"))) if first else copies.filter("n = 1")
    ranges = copies.select("_row", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    rest = pieces.join(kinds.join(mixed, "anchor"), ["anchor", "digest"]).filter(here.eqNullSafe(F.col("least")))
    large = (F.col("kinds") > group).alias("large")
    return ranges, rest.select("doc_id", "_row", "lo", F.col("total").alias("n"), "anchor", large, "strip")


def repeated_ranges(docs: DataFrame, length: int, keep: str, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Byte ranges ``_row, start, end`` to remove; they may overlap. ``docs``: doc_id, text, _row."""
    strips = cut(_strips(docs, length, gram))
    kinds = cut(
        strips.groupBy("anchor", "digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_row", "lo", "hi")).alias("at")
        )
    )
    copies = strips.join(kinds.filter("n > 1"), ["anchor", "digest"])
    if keep == "first":
        here = F.struct("doc_id", "_row", "lo")
        copies = copies.filter(~here.eqNullSafe(F.struct("at.doc_id", "at._row", "at.lo")))
    settled = copies.select("_row", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = (
        kinds.join(mixed, "anchor")
        .groupBy(F.col("at._row").alias("_row"))
        .agg(
            F.collect_list(
                F.struct("at.lo", "at.hi", "n", "anchor", (F.col("kinds") > group).alias("large"))
            ).alias("wanted")
        )
    )
    # Rows that repeat doc_id and text have one _row: one of them is enough here.
    texts_wanted = docs.join(wanted, "_row").select("doc_id", "text", "_row", "wanted")
    cut_out = cut(_extract(texts_wanted, length))
    small, large, width = cut_out.filter("not large"), cut_out.filter("large"), length - gram + 1
    while width > 1 and not large.isEmpty():
        width = -(-width // CELLS)
        pieces = cut(_divided(large, length, gram, width))
        ranges, rest = _settled_pieces(pieces, length, keep == "first", group)
        rest = cut(rest)
        settled, small, large = settled.union(ranges), small.union(rest.filter("not large")), rest.filter("large")
    # Pieces of one string each are settled: a group of several kinds of them shares its hash by chance.
    ordered = small.union(large).repartition("anchor").sortWithinPartitions("anchor")
    return settled.union(_sorted_groups(ordered, length, keep == "first"))


def _ranged(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """``rows`` (doc_id, text, _row and more) with the byte ranges to remove, or null."""
    ranges = (
        repeated_ranges(rows.select("doc_id", "text", "_row"), length, keep)
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    )
    return rows.join(ranges, "_row", "left")


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order, those that touch joined."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in ranges or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for s, e in spans:
        left.append(raw[at:s])
        at = e
    return b"".join(left) + raw[at:] if spans else raw


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans less the bytes at their ends that belong to characters partly outside."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """Every row of ``docs``: doc_id, n_bytes, spans (start, end of the removed runs), kept (binary)."""
    rows = texts(docs).withColumn("_row", F.xxhash64("doc_id", "text"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            spans = [merged(r) for r in block.rows["ranges"].to_pylist()]
            kept = [without(block.raw(i), own) for i, own in enumerate(spans)]
            listed = [[{"start": s, "end": e} for s, e in own] for own in spans]
            yield batch(schema, block.rows["doc_id"], np.diff(block.at), listed, kept)

    found = _ranged(rows, length, keep).select("doc_id", "text", "ranges")
    return found.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def strip_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, whole characters only; n_chars follows.

    All rows and columns stay; a text that repeats as a whole becomes empty.
    """
    names = docs.columns
    whole = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    own = {n: f"c{i}" for i, n in enumerate(names)}
    rows = whole.withColumns(
        {"doc_id": F.col(own["doc_id"]).cast("long"), "text": F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))}
    ).withColumn("_row", F.xxhash64("doc_id", "text"))
    kept = [c for n, c in own.items() if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = []
            for i, ranges in enumerate(block.rows["ranges"].to_pylist()):
                raw = block.raw(i)
                out.append(without(raw, whole_characters(raw, merged(ranges))).decode("utf-8", "replace"))
            columns = [*(block.rows[c] for c in kept), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text"])

    found = _ranged(rows, length, keep).select(*kept, "text", "ranges")
    types = [f"{c} {found.schema[c].dataType.simpleString()}" for c in kept]
    done = found.mapInArrow(run, ", ".join([*types, "text string"]))
    result = {n: F.col("text") if n == "text" else F.col(c) for n, c in own.items()}
    if "n_chars" in own:
        result["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[c.alias(n) for n, c in result.items()])
