"""Stored postings: trees, segments and compaction against plain sets; places in a taxonomy."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import items, keys, make_values
from folioframe.operators import postings as p
from folioframe.operators import search, taxonomy

WORDS = ["a", "b", "cc", "d1", "rare"]
TREE = [("t", 1, None, "r"), ("t", 2, 1, "x"), ("t", 3, 2, "y"), ("t", 4, 1, "z"), ("t", 9, None, "s"), ("u", 2, None, "o")]
SUBTREE = {1: {1, 2, 3, 4}, 2: {2, 3}, 3: {3}, 4: {4}, 9: {9}}


def records(pick, ids):
    """Random records: key to (words, fields, items)."""
    out = {}
    for key in ids:
        words = {w for w in WORDS[:4] if pick.random() < 0.4} | ({"rare"} if pick.random() < 0.02 else set())
        out[key] = words, pick.choice([None, 1, 2, 3, 4, 9]), pick.random() < 0.3
    return out


def as_values(spark, recs):
    rows = []
    for key, (words, item, marked) in recs.items():
        rows.append((key, "title", "text", " ".join(sorted(words)) + "!"))
        if item:
            rows.append((key, "topic", "txo", ("t", item)))
        if marked:
            rows.append((key, "mark", "id", "m"))
    return make_values(spark, rows)


def parts(spark, recs, places):
    values = as_values(spark, recs)
    held = spark.createDataFrame([(k,) for k in recs], "key bigint")
    topics = taxonomy.with_places(values.filter("attr = 'topic'"), places)
    return [p.word_rows(values), p.field_rows(values), p.item_rows(topics), p.key_rows(held)]


def tree(pick, places, depth):
    """A random condition and the plain test it stands for."""
    if depth == 0:
        kind = pick.randrange(5)
        if kind == 0:
            w = pick.choice(WORDS + ["none"])
            return p.any_word(w.upper()), lambda r: w in r[0]
        if kind == 1:
            f = pick.choice(["mark", "topic", "title", "none"])
            has = {"mark": lambda r: r[2], "topic": lambda r: r[1] is not None, "title": lambda r: True}
            return p.has_field(f), has.get(f, lambda r: False)
        if kind == 2:
            i = pick.choice([1, 2, 3, 4, 9, 77])
            return p.in_taxonomy("topic", "t", places[i]), lambda r: r[1] in SUBTREE.get(i, ())
        return (p.null(), lambda r: True) if kind == 3 else tree(pick, places, 1)
    (a, fa), (b, fb) = tree(pick, places, depth - 1), tree(pick, places, depth - 1)
    kind = pick.randrange(3)
    if kind == 0:
        return a & b, lambda r: fa(r) and fb(r)
    if kind == 1:
        return a | b, lambda r: fa(r) or fb(r)
    return ~a, lambda r: not fa(r)


@pytest.fixture(scope="module")
def places(spark):
    return taxonomy.intervals(items(spark, TREE)).cache()


def test_random_trees_over_segments(spark, places, tmp_path):
    pick = random.Random(7)
    path = str(tmp_path / "store")
    ids = [*range(1, 200), *range(32700, 32830), 10**9, 10**12]  # words, buckets and gaps
    state = records(pick, ids)
    p.write(p.build(*parts(spark, state, places)), path)
    ranges = {i: taxonomy.bounds(places, "t", i) for i in (1, 2, 3, 4, 9, 77)}

    def check(n, seed):
        choose = random.Random(seed)
        stored = p.read(spark, path)
        for depth in [0, 1, 2, 3, 4][:n]:
            condition, test = tree(choose, ranges, depth)
            want = sorted(k for k, r in state.items() if test(r))
            assert keys(p.match(stored, condition)) == want
            assert p.count(stored, condition).first().n == len(want)

    check(5, 1)
    # An update of some keys, new keys, then deletions, each once or twice.
    changed = records(pick, [*ids[:40], 300, 301])
    state |= changed
    for _ in range(2):
        gone = spark.createDataFrame([(k,) for k in changed], "key bigint")
        p.write(p.change(gone, *parts(spark, changed, places)), path, 1)
    check(5, 2)
    deleted = [5, 6, 32768, 10**9, 300]
    for k in deleted:
        del state[k]
    p.write(p.change(spark.createDataFrame([(k,) for k in deleted], "key bigint")), path, 2)
    # A key that comes back after its deletion.
    state |= (back := records(pick, [5]))
    p.write(p.change(spark.createDataFrame([(5,)], "key bigint"), *parts(spark, back, places)), path, 3)
    check(5, 3)
    terms = sorted((w, k) for k, r in state.items() for w in r[0])
    index = lambda: [(t, k) for t, k in sorted(map(tuple, p.term_keys(p.read(spark, path)).collect())) if "/" not in t]
    assert index() == terms
    assert p.compact(spark, path) == 4
    assert p.segments(p.read(spark, path)) == [0, 4]
    assert index() == terms
    check(5, 4)
    counts = {r.term: r.n_records for r in p.term_stats(p.read(spark, path)).collect()}
    assert all(counts.get(w, 0) == sum(w in r[0] for r in state.values()) for w in WORDS)


def test_a_change_costs_what_it_changes(spark, places, tmp_path):
    path = str(tmp_path / "store")
    state = records(random.Random(3), range(1, 3000))
    p.write(p.build(*parts(spark, state, places)), path)
    few = {k: state[k] for k in (10, 11)}
    p.write(p.change(spark.createDataFrame([(10,), (11,)], "key bigint"), *parts(spark, few, places)), path, 1)
    sizes = {r.segment: r.n for r in p.read(spark, path).groupBy("segment").agg(F.sum(F.size("words")).alias("n")).collect()}
    assert sizes[1] <= 20 < sizes[0] / 10


def test_sets_and_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    members = spark.createDataFrame([(1, 5), (1, 70), (2, 70), (2, 80)], "rs_id bigint, key bigint")
    p.write(p.build(p.set_rows(members)), path)
    stored = p.read(spark, path)
    one, two = p.in_set(1), p.in_set(2)
    assert keys(p.match(stored, one & two)) == [70] and keys(p.match(stored, one | two)) == [5, 70, 80]
    assert keys(p.match(stored, p.all_of(None, one))) == [5, 70] and keys(p.match(stored, p.any_of(two, None))) == [70, 80]
    assert p.count(stored, p.in_set(3)).first().n == 0
    with pytest.raises(search.InvalidQuery):
        from folioframe.plans.bindings import DOC_SCHEMA

        p.has_field("nonsense", DOC_SCHEMA)


def test_only_the_terms_of_the_query_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    p.write(p.build(*[p.key_rows(spark.range(1, 50).withColumnRenamed("id", "key"))]), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = p.match(p.read(spark, path), p.any_word("x") & p.in_taxonomy("f", "g", (3, 9)))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(at,3)" in plan and "EqualTo(name,x)" in plan


def plain_places(rows):
    out, at = {}, {}
    for grp in {g for g, *_ in rows}:
        at[grp] = 0
        children = {}
        for g, i, parent, _ in rows:
            if g == grp:
                children.setdefault(parent, []).append(i)

        def walk(i, grp=grp, children=children):
            begin = at[grp]
            at[grp] += 1
            for c in sorted(children.get(i, [])):
                walk(c)
            out[grp, i] = begin, at[grp] - 1

        for root in sorted(children[None]):
            walk(root)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_places(spark, shape):
    pick = random.Random(5)
    n = 70
    parent = {"random": lambda i: pick.choice([None, *range(max(0, i - 6), i)]), "chain": lambda i: i - 1 if i else None, "star": lambda i: 0 if i else None}[shape]
    names = list(range(n))
    pick.shuffle(names)
    rows = [("g", names[i], None if (q := parent(i)) is None else names[q], str(i)) for i in range(n)] + TREE
    got = {(r.grp, r.id): (r.begin, r.end) for r in taxonomy.intervals(items(spark, rows)).collect()}
    assert got == plain_places(rows)


def test_places_of_a_cycle_and_of_nothing(spark):
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.intervals(items(spark, [("g", 1, 2, "a"), ("g", 2, 1, "b"), ("g", 3, None, "c")]))
    none = items(spark, TREE).limit(0)
    assert taxonomy.intervals(none).count() == 0
    assert taxonomy.bounds(taxonomy.intervals(none), "t", 1) == (0, -1)


def test_subtree_of_values(spark, places):
    values = make_values(spark, [(k, "topic", "txo", ("t", i)) for k, i in ((1, 1), (2, 3), (3, 4), (4, 9), (5, 55))])
    found = search.match_values(taxonomy.with_places(values, places), search.in_subtree("topic", taxonomy.bounds(places, "t", 2)))
    assert keys(found) == [2]


def test_keys_of_words_are_compiled_and_whole(spark):
    """Every place of a word, and no function for each element of an array; postings group by name first."""
    ids = [0, 1, 62, 63, 64, 127, (1 << 15) - 1, 1 << 15, (3 << 15) + 63]
    built = p.build(p.key_rows(spark.createDataFrame([(k,) for k in ids], "key bigint")))
    words = p._words(built)
    found = p._keys(words, F.col("kind"))
    assert found.columns == ["kind", "key"]
    assert sorted(r.key for r in found.collect()) == ids
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    gathered = built._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [name#" in gathered and "Aggregate [kind#" not in gathered
