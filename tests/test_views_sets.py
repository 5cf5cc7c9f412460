import random

import pytest
from conftest import items, keys, make_values
from folioframe.operators import index, sets, taxonomy, views
from pyspark.sql import functions as F

ORDER = [(1, "a", "ABC"), (1, "a", "ABC"), (2, "a", "ABC"), (2, "a", "BCD"), (3, "a", "ABC"), (3, "b", "XYZ"),
         (4, "a", "ABC"), (4, "b", "ABC"), (5, "a", "ABC"), (6, "a", "ABC"), (7, "a", "ABC"), (8, "a", "ABC")]
VIEW = [(1, "enum", "txo", ("type", 1)), (2, "enum", "txo", ("type", 2)), (3, "enum", "txo", ("type", 2)), (4, "enum", "txo", ("type", 2)),
        (1, "text", "text", "ABC"), (2, "text", "text", "BCD"), (3, "text", "text", "CDE"), (4, "text", "text", "ABC"),
        (1, "date", "date", (2000, None, None)), (2, "date", "date", (2000, 12, None)), (3, "date", "date", (1999, None, None))]


def in_order(df):
    return [r.key for r in df.orderBy("pos").collect()]


def test_order_by_one_and_two_fields(spark):
    values = make_values(spark, [(k, a, "text", t) for k, a, t in ORDER])
    assert in_order(views.view(values, values, [("a", True)]))[-2:] == [1, 2]
    assert in_order(views.view(values, values, [("a", True), ("b", True)]))[-4:] == [4, 3, 1, 2]
    assert in_order(views.view(values, values, [("a", False)]))[:2] == [2, 1]


def test_view_positions(spark):
    values = make_values(spark, VIEW).cache()
    by_text = views.view(values, values, [("text", True)]).cache()
    assert in_order(by_text) == [1, 4, 2, 3]
    assert in_order(views.view(values, values, [("date", True)])) == [4, 3, 1, 2]
    assert keys(views.at(by_text, 2)) == [2]
    wanted = spark.createDataFrame([(1,), (3,), (99,)], "key bigint")
    assert {r.key: r.pos for r in views.index_of(by_text, wanted).collect()} == {1: 0, 3: 3, 99: None}
    assert [r.key for r in views.first(values, values, [("text", True)], 2, 1).collect()] == [4, 2]


def test_long_lists_order_as_whole_lists(spark, monkeypatch):
    monkeypatch.setattr(views, "CHUNK", 3)
    rng = random.Random(5)
    lists = {k: [rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 10, 30]))] for k in range(1, 40)}
    lists[40] = lists[41] = ["a"] * 31
    lists[42] = ["a"] * 30
    values = make_values(spark, [(k, "f", "text", v) for k, vs in lists.items() for v in vs])
    everyone = spark.createDataFrame([(k,) for k in lists], "key bigint")
    assert in_order(views.view(values, everyone, [("f", True)])) == sorted(lists, key=lambda k: (lists[k], k))


def test_positions_by_selection(spark):
    rng = random.Random(9)
    rows = [(k, "f", "text", rng.choice("abc")) for k in range(1, 90) for _ in range(rng.choice([0, 1, 1, 2]))]
    rows += [(k, "g", "date", (rng.choice([1999, 2000]), None, None)) for k in range(1, 60)]
    values = make_values(spark, rows).cache()
    everyone = spark.range(1, 90).select(F.col("id").alias("key"))
    by = [("f", False), ("g", True)]
    whole = in_order(views.view(values, everyone, by))
    for position, n in ((0, 1), (37, 20), (85, 20), (200, 3)):
        got = views.select(values, everyone, by, position, n, pieces=4).collect()
        assert sorted((r.pos, r.key) for r in got) == list(enumerate(whole))[position : position + n]
    for key in (whole[0], whole[50]):
        assert [tuple(r) for r in views.position_of(values, everyone, by, key).collect()] == [(key, whole.index(key))]
    assert views.position_of(values, everyone, by, 1000).count() == 0
    assert views.select(values, everyone.limit(0), by, 0, 5).count() == 0


def test_collate(spark):
    values = make_values(spark, VIEW)
    named = taxonomy.resolve(values.filter("attr = 'enum'"), items(spark, [("type", 1, None, "Journal"), ("type", 2, None, "Book")]))
    assert {(r.name, r.key) for r in named.select("name", "key").collect()} == {("Journal", 1), ("Book", 2), ("Book", 3), ("Book", 4)}
    parts = sets.collate(values, "date", values)
    assert {(r.value, r.n) for r in sets.part_sizes(parts).collect()} == {("2000--", 1), ("2000-12-", 1), ("1999--", 1), (None, 1)}


def test_adding_twice_and_destroying(spark):
    five = spark.range(1, 6).select(F.col("id").alias("key"))
    member = sets.add(sets.add(sets.of(five.limit(0), 1), 1, five), 1, five)
    assert keys(sets.select(member, 1)) == [1, 2, 3, 4, 5]
    values = make_values(spark, [(k, "t", "text", f"w{k}") for k in range(1, 8)])
    other = sets.of(spark.createDataFrame([(5,), (6,)], "key bigint"), 2)
    left, rows, members = sets.destroy(values, index.index_rows(values), member.union(other), 1)
    assert keys(left) == [6, 7] == keys(rows)
    assert [tuple(r) for r in members.collect()] == [(2, 6)]
    assert keys(values) == list(range(1, 8))


def test_algebra(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "key bigint") for ks in ((1, 2, 3), (3, 4)))
    assert keys(sets.union(a, b)) == [1, 2, 3, 4] and keys(sets.intersect(a, b)) == [3]
    assert keys(sets.minus(a, b)) == [1, 2] and keys(sets.complement(b, a)) == [1, 2]


def test_stored_sets(spark, tmp_path):
    path = str(tmp_path / "rs")
    keys_ = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key bigint")
    sets.save(path, 1, "one", keys_(1, 2, 2))
    sets.save(path, 2, "two", keys_(3))
    sets.save(path, 1, "uno", keys_(7))
    assert keys(sets.load(spark, path, 1)) == [7] and keys(sets.load(spark, path)) == [3, 7]
    assert {tuple(r) for r in sets.listing(spark, path).collect()} == {(1, "uno"), (2, "two")}
    sets.drop(spark, path, 1)
    assert [tuple(r) for r in sets.listing(spark, path).collect()] == [(2, "two")]


@pytest.mark.parametrize(("low", "high"), [
    (["ABC"], ["BCD"]), (["ABC", "ABC"], ["ABC", "BCD"]), (["ABC"], ["ABC", "BCD"]), (["ABC"], ["ABCD"]), (["ABC", "DEF"], ["ABCD", "EF"])])
def test_pairs(spark, low, high):
    values = make_values(spark, [(2, "f", "text", v) for v in low] + [(1, "f", "text", v) for v in high])
    assert in_order(views.view(values, values, [("f", True)])) == [2, 1]
    assert in_order(views.view(values, values, [("f", False)])) == [1, 2]
