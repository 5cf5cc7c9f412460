import random

import pytest
from conftest import items, keys, make_values
from folioframe import model as m
from folioframe.operators import index, search, sets, taxonomy
from folioframe.operators.search import nested, stored
from pyspark.sql import functions as F

TREE = [("a", 1, None, "one"), ("a", 2, None, "two"), ("a", 3, 2, "three")]
BOOL = [(1, "txo", "txo", ("a", 2)), (2, "txt", "text", "First"), (3, "txo", "txo", ("a", 3)),
        (3, "txt", "text", "First"), (4, "txo", "txo", ("a", 1)), (4, "txt", "text", "Second")]


@pytest.fixture(scope="module")
def library(spark):
    paths = taxonomy.paths(taxonomy.closure(items(spark, TREE)))
    return taxonomy.with_paths(make_values(spark, BOOL), paths).cache()


def test_and_or_not(library):
    two, first = search.in_taxonomy("txo", "a", 2), search.any_word("First")
    assert keys(search.match_values(library, two & first)) == [3]
    assert keys(search.match_values(library, two | first)) == [1, 2, 3]
    assert keys(search.match_values(library, ~(two | first))) == [4]


def test_not_counts_records_without_values(spark, library):
    everyone = spark.createDataFrame([(k,) for k in range(1, 7)], "key bigint")
    assert keys(search.match_values(library, ~search.any_word("first"), everyone)) == [1, 4, 5, 6]


def test_subtree(library):
    for item, expected in ((1, [4]), (2, [1, 3]), (3, [3])):
        assert keys(search.match_values(library, search.in_taxonomy("txo", "a", item))) == expected


def test_empty_condition_is_neutral_on_both_sides(library):
    first = search.any_word("first")
    for both in (search.all_of(None, first), search.all_of(first, None), search.any_of(None, first)):
        assert keys(search.match_values(library, both)) == [2, 3]
    assert keys(search.match_values(library, search.null())) == [1, 2, 3, 4]


def test_field_presence_includes_empty_text(spark):
    values = make_values(spark, [(1, "a", "text", "Toto"), (2, "b", "url", "toto"), (3, "a", "text", "x"), (3, "b", "url", "y"), (4, "a", "text", "")])
    assert keys(search.match_values(values, search.has_field("a"))) == [1, 3, 4]


def test_query_check():
    schema = m.Schema("s", {"txt": m.Attribute("text"), "txo": m.Attribute("txo", grp="a")})
    search.has_field("txt", schema)
    with pytest.raises(search.InvalidQuery):
        search.has_field("nope", schema)
    with pytest.raises(search.InvalidQuery):
        search.in_taxonomy("txt", "a", 1, schema)


def test_deep_closure_and_cycle(spark):
    chain = [("g", i, i - 1 if i else None, str(i)) for i in range(11)]
    closed = taxonomy.closure(items(spark, chain))
    assert closed.count() == 11 * 12 // 2
    assert closed.filter("ancestor = 0").count() == 11
    with pytest.raises(ValueError):
        taxonomy.closure(items(spark, [("g", 1, 2, "a"), ("g", 2, 1, "b")])).count()


def test_prune_keeps_the_most_specific(spark):
    tree = items(spark, [("g", 1, None, "1"), ("g", 2, 1, "2"), ("g", 3, 1, "3"), ("g", 4, 3, "4")])
    values = make_values(spark, [(7, "f", "txo", ("g", i)) for i in (1, 2, 3, 4)] + [(8, "f", "txo", ("g", 1))])
    left = taxonomy.prune(values, taxonomy.closure(tree)).select("key", "txo.id").collect()
    assert sorted(map(tuple, left)) == [(7, 2), (7, 4), (8, 1)]


def test_index_and_filters_equal_brute_force(spark):
    rng = random.Random(11)
    words = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    rows, truth = [], {}
    for key in range(1, 17):
        for attr, kind in (("title", "text"), ("title", "text"), ("url", "url"), ("author", "person")):
            chosen = rng.sample(words, 5)
            if kind == "text":
                payload = ", ".join(w.upper() if rng.random() < 0.3 else w for w in chosen)
            elif kind == "url":
                payload = f"http://{chosen[0]}.{chosen[1]}/{'/'.join(chosen[2:])}.html?zz=1"
            else:
                payload = (chosen[0], " ".join(chosen[1:3]), chosen[3], chosen[4])
                chosen = chosen[1:4]
            rows.append((key, attr, kind, payload))
            for w in chosen:
                truth.setdefault(w, set()).add(key)
    values = make_values(spark, rows).cache()
    body = F.struct(*m.VALUE_COLUMNS)
    per_field = values.groupBy("key", "attr").agg(F.sort_array(F.collect_list(F.struct("pos", body.alias("v")))).alias("l"))
    records = per_field.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("attr", F.col("l.v")))).alias("attrs")
    )
    records = search.searchable(records).cache()
    rows_ = index.index_rows(values).cache()
    assert sorted(map(tuple, rows_.collect())) == sorted(map(tuple, index.index_rows_nested(records).collect()))
    found = {}
    for r in rows_.collect():
        found.setdefault(r.term, set()).add(r.key)
    assert found == truth
    for w in rng.sample(words, 6) + ["zz", "html", "a-b", ""]:
        expected = sorted(truth.get(w, ()))
        assert keys(index.lookup(rows_, w)) == expected
        assert keys(search.match_values(values, search.any_word(w))) == expected
        assert keys(search.match(records, nested.any_word(w))) == expected
        assert keys(search.match(records, stored.any_word(w))) == expected


def test_words_of_any_script(spark):
    values = make_values(spark, [(1, "t", "text", "Élan vital_x, naïve"), (2, "t", "text", "Elan 12"), (3, "t", "text", "vélan élans")])
    for word, expected in (("élan", [1]), ("ÉLAN", [1]), ("elan", [2]), ("12", [2]), ("vital_x", [1]), ("vital", []), ("na", [])):
        assert keys(search.match_values(values, search.any_word(word))) == expected, word


def test_qualifiers_are_not_searched(spark):
    values = make_values(spark, [(1, "t", "text", "seen")]).withColumn(
        "quals", F.array(m.qual("note", "text", F.lit("hidden")))
    )
    assert keys(search.match_values(values, search.any_word("seen"))) == [1]
    assert keys(search.match_values(values, search.any_word("hidden"))) == []
    assert keys(search.match_values(values, search.has_field("note"))) == []


def test_index_upkeep(spark):
    rows = index.index_rows(make_values(spark, [(1, "t", "text", "a"), (2, "t", "text", "b")]))
    changed = spark.createDataFrame([(2,)], "key bigint")
    rows = index.update(rows, changed, make_values(spark, [(2, "t", "text", "c")]))
    assert [keys(index.lookup(rows, w)) for w in "abc"] == [[1], [], [2]]
    gone = spark.createDataFrame([(1,)], "key bigint")
    rows = index.update(rows, gone, make_values(spark, [(9, "t", "text", "x")]).limit(0))
    assert [keys(index.lookup(rows, w)) for w in "abc"] == [[], [], [2]]


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(index.index_rows(make_values(spark, [(k, "t", "text", "hot w%d" % k) for k in range(1, 60)])), path)
    stored_ = index.read_index(spark, path)
    assert len(keys(index.lookup(stored_, "HOT"))) == 59 and keys(index.lookup(stored_, "w7")) == [7]
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,hot)]" in index.lookup(stored_, "hot")._jdf.queryExecution().toString()


def test_prune_moves_the_rest_up_and_collate_takes_the_first(spark):
    tree = items(spark, [("g", 1, None, "top"), ("g", 2, 1, "below"), ("g", 3, None, "other")])
    txo = lambda i: {"grp": "g", "id": i}
    values = make_values(spark, [(1, "a", "txo", txo(1)), (1, "a", "txo", txo(2)), (1, "a", "txo", txo(3)), (2, "a", "txo", txo(3))])
    left = taxonomy.prune(values, taxonomy.closure(tree))
    assert sorted((r.key, r.pos, r.txo.id) for r in left.collect()) == [(1, 0, 2), (1, 1, 3), (2, 0, 3)]
    gap = values.filter("pos > 0")
    parts = {r.key: r.value for r in sets.collate(gap, "a", values.select("key")).collect()}
    assert parts[1] == "g/2" and parts[2] is None


def test_saving_a_set_empty(spark, tmp_path):
    path, keys_ = str(tmp_path / "sets"), spark.range(3).withColumnRenamed("id", "key")
    assert sets.listing(spark, path).count() == 0
    sets.save(path, 1, "one", keys_)
    sets.save(path, 2, "two", keys_.limit(1))
    sets.save(path, 1, "one", keys_.limit(0))
    assert sets.load(spark, path, 1).count() == 0 and sets.load(spark, path).count() == 1
    assert sorted(map(tuple, sets.listing(spark, path).collect())) == [(1, "one"), (2, "two")]
    sets.drop(spark, path, 2)
    assert [r.rs_id for r in sets.listing(spark, path).collect()] == [1]
