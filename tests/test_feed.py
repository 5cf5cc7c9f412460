import random

from conftest import make_values
from folioframe import model as m
from folioframe.operators import index, postings, sets
from folioframe.streaming import feed
from pyspark.sql import functions as F

CHANGES = "key bigint, seq bigint, op string, payload string"


def changes_of(n, seed=7):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, 4]), s, rng.choice(feed.OPS), f"p{s}") for s in range(n)]


def loop(changes):
    state, wrong = {}, []
    for key, seq, op, payload in sorted(changes, key=lambda c: c[1]):
        if (key in state) == (op == "add"):
            wrong.append(seq)
        elif op == "delete":
            del state[key]
        else:
            state[key] = payload
    return state, wrong


def live(df):
    return {r.key: r.payload for r in feed.records(df).collect()}


def test_batch_equals_a_loop(spark):
    changes = changes_of(300)
    df = spark.createDataFrame(changes, CHANGES).repartition(5)
    state, wrong = feed.apply_changes(feed.empty_state(df), df)
    assert (live(state), sorted(r.seq for r in wrong.collect())) == loop(changes)


def test_stream_in_batches_equals_a_loop(spark, tmp_path):
    changes = changes_of(90)
    for i in range(3):
        part = spark.createDataFrame(changes[i * 30:(i + 1) * 30], CHANGES)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = feed.StateTable(spark, str(tmp_path / "state"), "key bigint, live boolean, payload string, seq bigint", buckets=3)
    feed.follow(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(table._batches()) == 3
    assert live(table.read()) == loop(changes)[0]
    # a batch that is delivered again, as known or as new, changes nothing
    again = spark.createDataFrame(changes[60:], CHANGES)
    table.apply(again, 2)
    table.apply(again, 3)
    assert live(table.read()) == loop(changes)[0]
    table.vacuum()
    assert live(table.read()) == loop(changes)[0]
    wrong = spark.read.parquet(str(tmp_path / "state" / "violations"))
    assert sorted(r.seq for r in wrong.filter("batch < 3").collect()) == loop(changes)[1]


def test_index_and_sets_follow(spark):
    values = make_values(spark, [(1, "t", "text", "a"), (2, "t", "text", "b")])
    state = spark.createDataFrame([(1, True, "a", 0), (2, True, "b", 0)], "key bigint, live boolean, payload string, seq bigint")
    changes = spark.createDataFrame([(1, 1, "delete", None), (2, 2, "update", "c")], CHANGES)
    judged = feed.judge(state, changes)
    after = feed.next_state(state, judged)
    now = make_values(spark, [(r.key, "t", "text", r.payload) for r in feed.records(after).collect()])
    member = sets.of(values, 9)
    rows, members = feed.refresh(index.index_rows(values), member, judged, now)
    assert [tuple(r) for r in rows.collect()] == [("c", 2)] and [tuple(r) for r in members.collect()] == [(9, 2)]
    only = feed.of_members(changes, sets.of(values.filter(F.col("key") == 2), 9), 9)
    assert [r.key for r in only.collect()] == [2]


def three_batches(spark, folder, changes):
    for i in range(3):
        part = spark.createDataFrame(changes[i * 30:(i + 1) * 30], CHANGES)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(folder)


def test_postings_follow_the_stream(spark, tmp_path):
    changes = changes_of(90, seed=3)
    stream = three_batches(spark, str(tmp_path / "in"), changes)
    table = feed.StateTable(spark, str(tmp_path / "state"), "key bigint, live boolean, payload string, seq bigint", buckets=3)
    index_path = str(tmp_path / "index")
    start = make_values(spark, [(k, "t", "text", "stale") for k in (1, 2, 3, 4, 77)])
    member = sets.of(start, 5)
    postings.write(postings.build(postings.word_rows(start), postings.key_rows(start), postings.set_rows(member)), index_path)

    def values(present):
        return m.values_of(present, F.col("key"), "t", F.lit(0), "text", F.col("payload"))

    want = {(p, k) for k, p in loop(changes)[0].items()} | {("stale", 77)}
    for run in range(2):  # the second run delivers every batch again
        feed.follow_index(stream, table, index_path, values, str(tmp_path / f"checkpoint{run}"), lambda: member).awaitTermination()
        stored = postings.read(spark, index_path)
        assert postings.segments(stored) == [0, 1000, 2000, 3000]
        assert {tuple(r) for r in postings.term_keys(stored).collect()} == want
        alive = set(loop(changes)[0]) | {77}
        assert {r.key for r in postings.match(stored, postings.in_set(5)).collect()} == alive
    # Compaction between batches takes a number that no batch has.
    assert postings.compact(spark, index_path) == 3001
    assert {tuple(r) for r in postings.term_keys(postings.read(spark, index_path)).collect()} == want


def test_notes_follow_a_set_that_changes(spark, tmp_path):
    changes = changes_of(90, seed=4)
    stream = three_batches(spark, str(tmp_path / "in"), changes)
    asked = []

    def members():
        asked.append(1)
        return spark.createDataFrame([(1, 1 if len(asked) == 1 else 2), (2, 3)], "rs_id long, key long")

    feed.notify(stream, members, 1, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [s for k, s, _, _ in changes if k == (1 if s < 30 else 2)] and len(asked) == 3
