"""Manifest, top-k search and phrases against plain versions on awkward rows and tiny blocks."""

import collections
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import merkle, phrases, queries, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, pos string, tree string"


def same(got, want):
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


def documents(spark, rows):
    queries.ship(spark)
    # The last three columns clash with names that the operators use.
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], DOCS).repartition(3)


# 11


def plain_manifest(rows):
    h = lambda parts: sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: h(map(field, (d, s, lang, n, t)))
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)

    def climb(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(levels, i):
        beside = []
        for row in levels[:-1]:
            run = range(i // 3 * 3, min(len(row), i // 3 * 3 + 3))
            beside.append(([row[j] for j in run if j < i], [row[j] for j in run if j > i]))
            i //= 3
        return beside

    groups = collections.defaultdict(list)
    for d, t, lang, s, n in rows:
        changed = t if t is None or d is None or zlib.crc32(str(d).encode()) % 2 else t.replace("\n", "")
        groups[s].append((first(d), leaf(d, t, lang, s, n), leaf(d, changed, lang, s, n), d))
    trees = []
    for s in sorted(groups, key=first):
        held = sorted(groups[s], key=lambda x: x[:2])
        trees.append((held, climb([x[1] for x in held])))
    upper = climb([t[-1][0] for _, t in trees])
    out = []
    for at, (held, tree) in enumerate(trees):
        for i, (_, own, shown, d) in enumerate(held):
            beside = path(tree, i) + path(upper, at)
            node = shown
            for left, right in beside:
                node = h([*left, node, *right])
            proof = h(x for left, right in beside for x in left + right)
            out.append((d, own, tree[-1][0], upper[-1][0], proof, node, node == upper[-1][0]))
    return out


def manifest_rows(seed):
    pick = random.Random(seed)
    source = lambda: pick.choice((None, "", "hot", "hot", "hot", "ä", "z", f"s{pick.randint(0, 30)}"))
    text = lambda: pick.choice((None, "", "a\nb", "\n", "é 1:x", "plain", "long " * 2000))
    rows = [(i, text(), pick.choice((None, "en")), source(), pick.choice((None, 3))) for i in range(140)]
    return rows + [rows[3], rows[3], (None, "n\n", None, "hot", 1), (None, "n\n", None, "hot", 1), (-5, "\n", "x", "z", -1)]


@pytest.mark.parametrize(("depth", "block"), [(1, 4), (2, 7), (merkle.DEPTH, merkle.BLOCK)])
def test_manifest(spark, depth, block):
    rows = manifest_rows(depth)
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.verify(documents(spark, rows), shown, depth, block).collect()
    same(got, plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 9, 10])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "a\n", None, "s", 1) for i in range(n)]
    same(merkle.verify(documents(spark, rows), F.translate("text", "\n", ""), 1, 2).select("leaf", "root").collect(),
         [(r[1], r[3]) for r in plain_manifest(rows)])


def test_manifest_of_nothing(spark):
    assert merkle.verify(documents(spark, [])).count() == 0


def test_octopus_is_least():
    for n in range(1, 30):
        for low in range(n):
            for high in range(low + 1, n + 1):
                wanted, known, size, level = set(), set(range(low, high)), n, 0
                while size > 1:
                    runs = {i // 3 for i in known}
                    wanted |= {(level, j) for i in runs for j in range(3 * i, min(size, 3 * i + 3)) if j not in known}
                    known, size, level = runs, -(-size // 3), level + 1
                got = merkle.octopus(n, low, high)
                assert set(got) == wanted and len(got) == len(wanted)


# 12


def plain_search(rows, every, k):
    kept = [(i, [int(np.floor(256 * float(np.float64(x)))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(kept) if a != b]
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def vectors(seed, n, width=5):
    pick = random.Random(seed)
    rows = [(i, [pick.choice((-1.0, 0.0, 0.25, pick.uniform(-1, 1))) for _ in range(width)]) for i in range(n)]
    rows += [(i, rows[7][1]) for i in range(n, n + n // 2)]  # a third are copies
    rows += [rows[10], rows[10], (None, rows[7][1]), (None, [9.0] * width), (10**6, None), (10**6 + 10, [None] * width)]
    return rows + [(10**6 + 20, [float("nan")] * width), (10**6 + 30, [float("inf")] * width), (-10, [1.0] * width),
                   (20, [0.5]), (30, []), (40, [0.0] * width)]


@pytest.mark.parametrize(("shard", "group", "tile"), [(40, 6, 10), (1000, 1000, 37), (topk.SHARD, topk.GROUP, topk.TILE)])
def test_search(spark, shard, group, tile, monkeypatch):
    queries.ship(spark)
    monkeypatch.setattr(topk.search_shard, "__defaults__", (tile,))
    rows = vectors(shard, 120)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, v array<double>, _shard int, score int").repartition(4)
    same(topk.search(table, "v", F.col("vec_id") % 10 == 0, 5, shard=shard, group=group).collect(), plain_search(rows, 10, 5))


def test_search_of_little(spark):
    queries.ship(spark)
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, v array<double>")
    assert topk.search(one, "v", F.col("vec_id") == 0, 5).count() == 0
    assert topk.search(one.limit(0), "v", F.col("vec_id") == 0, 5).count() == 0


def test_search_of_large_components(spark):
    queries.ship(spark)
    pick = random.Random(3)
    rows = [(i, [pick.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    same(topk.search(table, "v", F.col("vec_id") % 10 == 0, 4).collect(), plain_search(rows, 10, 4))


def test_lists_stop_early_and_miss_nothing():
    draw = np.random.default_rng(5)
    matrix = np.floor(draw.normal(size=(2000, 16)) * 32)
    lists = topk.Tile(matrix)
    asked = np.floor(draw.normal(size=(30, 16)) * 32)
    scores = matrix @ asked.T
    kth = np.sort(scores, axis=0)[-6]
    for floor in (np.full(30, -np.inf), kth):
        found = lists.best(asked, 6, floor)
        for q, rows in enumerate(found):
            assert set(np.flatnonzero(scores[:, q] >= kth[q])) <= set(rows)
        assert np.median([len(rows) for rows in found]) <= topk.SMALL
    # The bounds hold and close in on the score with the depth.
    weights = np.hstack([np.maximum(asked, 0), np.minimum(asked, 0)]).T
    for depth in (1, 700, 2000):
        possible, certain = (b @ weights for b in lists.bounds(depth))
        assert (certain <= scores).all() and (scores <= possible).all()
    assert (certain == scores).all() and (scores == possible).all()


# 13


def plain_collocations(rows, longest, least, top):
    out = []
    split = bytes.maketrans(b",;:!?\n\v\f\r\t", b"......... ")
    by_lang = collections.defaultdict(list)
    for _, text, lang, *_ in rows:
        clean = (text or "").encode().lower().translate(split)
        by_lang[lang or ("und" if lang is None else lang)] += [p.split(b" ") for p in clean.split(b".")]
    for lang, pieces in by_lang.items():
        f = collections.Counter()
        for piece in pieces:
            w = [x for x in piece if x]
            f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in good.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * c >= 50 * a for q, c in good.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, b" ".join(p), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


def speech(seed):
    pick = random.Random(seed)
    words = ["a", "B", "cc", "é", "x1", "日本", "the", "\x1c", "<i>"] + [f"w{i}" for i in range(20)]
    gap = lambda: pick.choice((" ", " ", " ", "\t", "  ", ", ", "\n", "!", "\r\n"))
    prose = lambda n: "".join(pick.choice(words) + gap() for _ in range(n))
    rows = [(i, prose(pick.randint(0, 120)), pick.choice((None, "en", "en", "und", "")), None, 1) for i in range(60)]
    return rows + [rows[5]] * 12 + [(None, None, "en", None, 1), (1, "", None, None, 1), (2, "...", "only stops", None, 1),
            (3, "a b cc " * 900, "long", None, 1), (4, "x" * 5000 + " y " + "x" * 5000, "long", None, 1)]


@pytest.mark.parametrize(("longest", "limit"), [(3, 200), (2, 3000), (4, 500), (3, phrases.BLOCK)])
def test_collocations(spark, longest, limit):
    rows = speech(limit)
    got = phrases.collocations(documents(spark, rows), longest, least=10, top=25, limit=limit).collect()
    same(got, plain_collocations(rows, longest, 10, 25))


def test_collocations_of_nothing(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, None, None, None)])).count() == 0


@pytest.mark.parametrize("n", [10, 5000, 400000])
def test_dense_and_sparse_tiles_agree(n):
    draw = np.random.default_rng(n)
    pairs = (draw.integers(0, 3 * phrases.TILE, n) ** 2 // 2000, draw.integers(0, 700, n))
    codes = (pairs[0] << 32) | pairs[1]
    want = collections.Counter(codes.tolist())
    found, uses = phrases.count_all(codes)
    assert dict(zip(found.tolist(), uses.tolist())) == want
    for tile in np.unique(phrases.tile_of(codes)):
        mine = codes[phrases.tile_of(codes) == tile]
        found, uses = phrases.count_codes(np.concatenate([mine, mine]), np.ones(2 * len(mine), np.int64))
        assert dict(zip(found.tolist(), uses.tolist())) == {c: 2 * want[c] for c in mine.tolist()}


def test_slices_of_a_long_text():
    text = b"one two three. four five six seven " * 50 + b"x" * 300 + b" last"
    whole = phrases.words(text)
    for limit in (10, 64, 1000):
        found = []
        for part, again in phrases.slices(text, limit, 2):
            part = phrases.words(part)
            assert not again or part[:again] == found[-again:]
            found += part[again:]
        assert found == whole
