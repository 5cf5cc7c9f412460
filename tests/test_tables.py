import random

import pytest
from conftest import items, keys, make_values
from folioframe import model as m
from folioframe.operators import tables
from pyspark.sql import functions as F

SCHEMA = m.Schema("s", {
    "author": m.Attribute("person", max_n=4), "url": m.Attribute("url", max_n=1),
    "qualified": m.Attribute("url", max_n=1, quals={"info": m.Qualifier("text")}),
    "text": m.Attribute("text"), "enum": m.Attribute("txo", grp="a"), "enum2": m.Attribute("txo", grp="c"),
})


def rules(spark, rows, quals=None):
    values = make_values(spark, rows)
    if quals is not None:
        values = values.withColumn("quals", m.quals(quals))
    found = tables.validate(values, SCHEMA, items(spark, [("z", 1, None, "n")]))
    return sorted((r.key, r.rule) for r in found.collect())


def test_rules(spark):
    who = ("", "F", "L", None)
    assert rules(spark, [(1, "text", "text", "x"), (1, "author", "person", who)]) == []
    assert rules(spark, [(1, "bozo", "text", "x")]) == [(1, "unknown_attribute")]
    assert rules(spark, [(1, "text", "text", "a"), (1, "text", "text", "b"), (1, "text", "url", "c")]) == [(1, "wrong_type")]
    assert rules(spark, [(1, "author", "person", who)] * 5) == [(1, "too_many")]
    assert rules(spark, [(1, "author", "url", "u")] * 2) == [(1, "wrong_type")] * 2
    assert rules(spark, [(1, "enum", "txo", ("b", 1))]) == [(1, "wrong_group")]
    assert rules(spark, [(1, "enum", "txo", ("a", 1))]) == [(1, "unknown_item")]
    assert rules(spark, [(1, "text", None, None)]) == [(1, "incomplete")]


def test_qualifier_rules(spark):
    row = [(1, "qualified", "url", "u")]
    assert rules(spark, row, m.qual("info", "text", F.lit("ok"))) == []
    assert rules(spark, row, m.qual("info", "url", F.lit("no"))) == [(1, "wrong_qualifier_type")]
    assert rules(spark, row, m.qual("bozo", "text", F.lit("no"))) == [(1, "unknown_qualifier")]


def test_unknown_type_is_refused():
    with pytest.raises(m.SchemaError):
        m.Schema("s", {"a": m.Attribute("float")})


def allocate(existing, feed):
    """The counter, one row at a time."""
    counter = max(existing, default=0) + 1
    taken, good, bad = set(existing), [], []
    for seq, proposed in sorted(feed):
        if proposed is None:
            key, counter = counter, counter + 1
        else:
            key = proposed
            if proposed >= counter:
                counter = proposed + 1
        (bad if key in taken else good).append((seq, key))
        taken.add(key)
    return good, bad


def test_keys_equal_a_sequential_counter(spark):
    rng = random.Random(2)
    feed = [(s, rng.choice([None, None, rng.randrange(1, 400)])) for s in range(300)]
    existing = [1, 2, 50]
    rows = spark.createDataFrame(feed, "seq bigint, proposed bigint").repartition(5)
    held = spark.createDataFrame([(k,) for k in existing], "key bigint")
    good, bad = tables.allocate_keys(rows, held)
    expected = allocate(existing, feed)
    assert sorted((r.seq, r.key) for r in good.collect()) == expected[0]
    assert sorted((r.seq, r.key) for r in bad.collect()) == expected[1]


@pytest.mark.parametrize(("feed", "expected"), [([None], [2]), ([None, 1], [2]), ([4, None], [4, 5])])
def test_first_keys(spark, feed, expected):
    rows = spark.createDataFrame(list(enumerate(feed)), "seq bigint, proposed bigint")
    good, _ = tables.allocate_keys(rows, spark.createDataFrame([(1,)], "key bigint"))
    assert [r.key for r in good.orderBy("seq").collect()] == expected


def test_fold(spark):
    feed = [("text.qtext", "some stuff"), ("text", "some stupid comment"), ("text.qtext", "even more stuff"),
            ("text", "another comment"), ("text.qtext", "stuff for another comment"), ("url", None), ("lone.q", "x")]
    rows = spark.createDataFrame([(1, i, f, "text", v) for i, (f, v) in enumerate(feed)], "key bigint, seq int, field string, type string, text string")
    values, quals, wrong = tables.fold_fields(rows)
    assert sorted((r.attr, r.pos, r.text) for r in values.collect()) == [("text", 0, "some stupid comment"), ("text", 1, "another comment")]
    assert sorted((r.pos, r.qpos, r.text) for r in quals.filter("attr = 'text'").collect()) == [
        (0, 0, "some stuff"), (0, 1, "even more stuff"), (1, 0, "stuff for another comment")]
    assert [(r.attr, r.rule) for r in wrong.collect()] == [("lone", "incomplete")]


def test_update_delete_diff(spark):
    old = make_values(spark, [(1, "t", "text", "a"), (2, "t", "text", "b"), (2, "t", "text", "c")])
    new = make_values(spark, [(2, "t", "text", "z"), (9, "t", "text", "q")])
    values, missing = tables.update_records(old, new)
    assert sorted((r.key, r.text) for r in values.collect()) == [(1, "a"), (2, "z")] and keys(missing) == [9]
    assert sorted((r.key, r.pos, r.change) for r in tables.diff_records(old, values).collect()) == [(2, 0, "changed"), (2, 1, "removed")]
    assert {r.key: r.equal for r in tables.records_equal(old, values).collect()} == {1: True, 2: False}
    qualified = old.withColumn("quals", m.quals(m.qual("n", "text", F.lit("x"))))
    assert tables.diff_records(old, qualified).count() == 3


def test_stored_database(spark, tmp_path):
    path = str(tmp_path / "db")
    values = make_values(spark, [(1, "text", "text", "é")])
    tables.create(path, values, SCHEMA, items(spark, [("a", 1, None, "x")]), "About it")
    stored = tables.open_tables(spark, path)
    assert stored["header"].first().header == "About it"
    assert tables.diff_records(values, stored["values"]).count() == 0
    with pytest.raises(FileExistsError):
        tables.create(path, values, SCHEMA, items(spark, [("a", 1, None, "x")]))
    tables.save(path, stored["values"].withColumn("text", F.upper("text")), SCHEMA, items(spark, [("a", 1, None, "x")]))
    assert [tables.open_tables(spark, path, back)["values"].first().text for back in (0, 1)] == ["É", "é"]
    members = spark.createDataFrame([(1, 1)], "rs_id bigint, key bigint")
    tables.save(path, values, SCHEMA, items(spark, [("a", 1, None, "x")]), member=members)
    assert tables.open_tables(spark, path)["member"].count() == 1 and "member" not in tables.open_tables(spark, path, 1)
    tables.destroy_tables(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.open_tables(spark, path)


def test_fields_and_names(spark):
    record = spark.range(1).select(
        F.lit(5).cast("bigint").alias("key"),
        m.attributes(
            a=F.array(m.value("text", F.lit("x"), m.quals(m.qual("q", "text", F.lit("r")))), m.value("text", F.lit("y"))),
            b=m.one(m.value("text", F.lit(None).cast("string"))),
        ).alias("attrs"),
    )
    row = record.select(
        m.one_value("a")["text"].alias("a"), m.one_value("a.q")["text"].alias("aq"), m.get_field("b").alias("b"),
        m.get_field("a.z").alias("az"), m.record_key().alias("k"), F.size(m.get_field("a")).alias("n"),
    ).first()
    assert (row.a, row.aq, row.b, row.az, row.k, row.n) == ("x", "r", None, None, "5", 2)
    names = F.create_map(F.lit(""), F.lit("Author"), F.lit("en"), F.lit("Author (en)"))
    got = spark.range(1).select(m.localized(names, "").alias("n"), m.localized(names, "en_US").alias("e"), m.localized(names, "fr").alias("f")).first()
    assert (got.n, got.e, got.f) == ("Author", "Author (en)", "Author")


def test_fingerprints_find_what_values_show(spark):
    """Random edits: equality and differences by fingerprints against all values compared."""
    pick = random.Random(2)
    base = [(k, attr, "text", pick.choice(["", "a", "b", None])) for k in range(60) for attr in ("t", "u") for _ in range(pick.randint(0, 3))]
    other = [(k, a, t, "c" if pick.random() < 0.1 else v) for k, a, t, v in base if pick.random() > 0.05] + [(99, "t", "text", "new")]
    a, b = make_values(spark, base), make_values(spark, other)
    want = sorted(tuple(r) for r in tables._diff_values(a, b).collect())
    assert want and sorted(tuple(r) for r in tables.diff_records(a, b).collect()) == want
    assert sorted(tuple(r) for r in tables.diff_records(a, b, few=0).collect()) == want
    equal = {r.key: r.equal for r in tables.records_equal(a, b).collect()}
    keys = {r[0] for r in base} | {r[0] for r in other}
    assert equal == {k: k not in {w[0] for w in want} for k in keys}
    # Columns that trade places, rows in another order, and a copy of a row.
    swapped = make_values(spark, [(1, "t", "text", "u"), (1, "u", "text", "t")])
    assert not tables.records_equal(swapped, make_values(spark, [(1, "t", "text", "t"), (1, "u", "text", "u")])).first().equal
    assert tables.records_equal(a, a.orderBy(F.desc("pos"))).filter("NOT equal").isEmpty()
    assert not tables.records_equal(swapped, swapped.union(swapped)).first().equal
    assert tables.diff_records(a.limit(0), b.limit(0)).isEmpty()
