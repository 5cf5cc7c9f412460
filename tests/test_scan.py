import random
from itertools import groupby

from folioframe.plans import scan
from pyspark.sql import functions as F


def rows_of(n=400, seed=3):
    rng = random.Random(seed)
    # group "hot" holds most rows; some groups are NULL
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice([None, rng.randrange(50)])) for i in rng.sample(range(10_000), n)]


def test_number_is_global(spark):
    df = spark.createDataFrame(rows_of(), "g string, i int, v int").repartition(5)
    got = {r.i: r.pos for r in scan.number(df, ["i"]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(got))}
    assert scan.place(df, ["i"]).select("_part").distinct().count() > 1


def test_descending_number(spark):
    df = spark.createDataFrame(rows_of(), "g string, i int, v int")
    got = {r.i: r.pos for r in scan.number(df, [F.col("i").desc()]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(got, reverse=True))}


def test_running_values_equal_a_loop(spark):
    data = rows_of()
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(5)
    outputs = {
        "n": ("count", F.col("v")), "s": ("sum", F.col("v")), "hi": ("max", F.col("v")),
        "lo": ("min", F.col("v")), "last": ("last", F.col("v")),
    }
    for inclusive in (True, False):
        got = {r.i: r for r in scan.run(scan.place(df, ["g", "i"]), ["g"], outputs, inclusive).collect()}
        order = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        for _, group in groupby(order, key=lambda r: r[0]):
            seen = []
            for _, i, v in group:
                if inclusive and v is not None:
                    seen.append(v)
                r = got[i]
                assert (r.n, r.s or 0) == (len(seen), sum(seen))
                assert r.hi == (max(seen) if seen else None) and r.lo == (min(seen) if seen else None)
                assert r.last == (seen[-1] if seen else None)
                if not inclusive and v is not None:
                    seen.append(v)


def test_rank_in_one_hot_group(spark):
    df = spark.range(1000).select(F.lit("x").alias("g"), (F.col("id") * 7919 % 1000).alias("i")).repartition(6)
    got = {r.i: r["rank"] for r in scan.rank(df, ["g"], ["i"]).collect()}
    assert got == {i: i + 1 for i in range(1000)}
