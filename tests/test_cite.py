"""Citation keys over several batches, against a plain loop."""

import random

from pyspark.sql import functions as F

from folioframe.operators import cite


def plain(based, given):
    """One document at a time: plain bases first, else the first free place, in order of citation."""
    taken = {(d, k) for d, _, k in given}
    known = {(d, u) for d, u, _ in given}
    out = list(given)
    for doc, uid, _, base in sorted((r for r in based if (r[0], r[1]) not in known), key=lambda r: (r[2], r[1])):
        n, key = 0, base
        while (doc, key) in taken:
            n += 1
            text, rest = "", n
            while rest:
                rest, at = divmod(rest - 1, 26)
                text = chr(97 + at) + text
            key = f"{base}:{text}"
        taken.add((doc, key))
        out.append((doc, uid, key))
    return out


def frames(spark, based, given):
    return (
        spark.createDataFrame(based, "doc long, uid long, at long, base string"),
        spark.createDataFrame(given, "doc long, uid long, cite_key string"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_given_keys_stay_and_gaps_are_filled(spark):
    pick = random.Random(5)
    based = [(pick.choice([1, 1, 1, 2]), uid, pick.randint(0, 50), pick.choice(["Gar06", "Gar06", "GF07", "Unknown", ""])) for uid in range(400)]
    given, used = [], set()
    for doc, uid, _, base in pick.sample(based, 90):
        key = base + pick.choice(["", ":a", ":c", ":z", ":aa", ":ab", ":b2", ":Q"])
        if (doc, key) not in used:
            used.add((doc, key))
            given.append((doc, uid, key))
    given.append((1, 9000, "Gar06:zzzzzzzzzzzz"))
    got = rows(cite.extend_alpha_keys(*frames(spark, based, given)))
    assert got == sorted(plain(based, given))
    assert set(given) <= set(got)
    assert len({(d, k) for d, _, k in got}) == len(got)
    # The same batch again changes nothing.
    assert rows(cite.extend_alpha_keys(*frames(spark, based, got))) == got


def test_generated_keys_that_are_plain_bases(spark):
    based = [(1, 1, 1, "X"), (1, 2, 2, "X"), (1, 3, 3, "X:a"), (1, 4, 4, "X"), (1, 5, 5, "X:a"), (1, 6, 6, "X:a:a")]
    got = rows(cite.extend_alpha_keys(*frames(spark, based, [])))
    assert got == [(1, 1, "X"), (1, 2, "X:c"), (1, 3, "X:a"), (1, 4, "X:b"), (1, 5, "X:a:b"), (1, 6, "X:a:a")]
    given = [(1, 7, "X:b"), (1, 8, "X:a:b")]
    keys = rows(cite.extend_alpha_keys(*frames(spark, based, given)))
    assert set(given) <= set(keys) and len({k for _, _, k in keys}) == len(keys) == 8


def test_numbers_go_on_after_the_largest(spark):
    based = [(1, uid, 10 - uid, "") for uid in range(1, 6)] + [(2, 1, 1, "")]
    given = [(1, 2, "7"), (1, 4, "note")]
    got = rows(cite.extend_numeric_keys(*frames(spark, based, given)))
    assert got == [(1, 1, "10"), (1, 2, "7"), (1, 3, "9"), (1, 4, "note"), (1, 5, "8"), (2, 1, "1")]


def test_no_citations_and_no_keys(spark):
    assert rows(cite.extend_alpha_keys(*frames(spark, [], [(1, 1, "A")]))) == [(1, 1, "A")]
    assert rows(cite.extend_numeric_keys(*frames(spark, [], []))) == []


def test_letters_and_their_numbers(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 26, 27, 52, 702, 703, 20000, 475255)], "n long")
    both = df.select("n", cite.letters_number(cite.letters(df.n)).alias("m")).collect()
    assert all(r.n == r.m for r in both)


def test_one_and_two_letters_need_no_function_for_each_letter(spark):
    def spelled(n):
        out = ""
        while n and n > 0:
            n, rest = divmod(n - 1, 26)
            out = chr(97 + rest) + out
        return out

    numbers = [None, -3, 0, *range(1, 800), 18277, 18278, 18279, 475255]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", cite.letters(F.col("n")).alias("s"))
    assert {r.n: r.s for r in rows.collect()} == {n: spelled(n) for n in numbers}
    # The general way comes last, after the branches of plain arithmetic.
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert 0 <= plan.find("CASE WHEN") < plan.find("aggregate(")
