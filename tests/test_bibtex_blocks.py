"""A BibTeX file gives the same records however it is cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.sources import bibtex


def library(seed, n):
    """Entries with lines that start with @ inside fields, stray braces, entries that never close."""
    pick = random.Random(seed)
    out = ["text before\n"]
    for i in range(n):
        lines = "".join(f"\n@line {j} of {i}" + pick.choice(["", " {in} braces", r" \{ and \}"]) for j in range(pick.choice([0, 0, 0, 1, 9])))
        kind = pick.randrange(14)
        if kind == 0:
            out.append(f"@article{{open{i}, title = {{never closed {i}\n")
        elif kind == 1:
            out.append(f"@misc{{stray{i}, title = {{x}}}} }}\n")
        elif kind == 2:
            out.append(f"@string{{jnl = {{Journal {i}}}}}\n")
        elif kind == 3:
            out.append("@comment no entry {\n}\n")
        else:
            out.append(f"@article{{k{i},\n title = {{Title {i}{lines}\n}},\n journal = jnl,\n year = {1900 + i}\n}}\n")
    return "".join(out)


def whole(pieces):
    """Pieces that belong together, by trying each start up to the end of the file."""
    at = 0
    while at < len(pieces):
        depth = 0
        for end in range(at, len(pieces)):
            depth += bibtex._open_braces(pieces[end])
            if depth <= 0:
                break
        else:
            end = at
        yield pieces[at : end + 1]
        at = end + 1


def expected(text):
    first, *rest = text.split("\n@")
    return [e for group in whole([first, *("@" + r for r in rest)]) for e in bibtex._parsed(group)]


def entries_of(spark, folder):
    rows = bibtex.read_entries(spark, str(folder)).orderBy("_file", "_block", "at", F.col("kind") == "entry").collect()
    return [(r.kind, r.type, r.cite_key, tuple((f.name, tuple(tuple(p) for p in f.parts)) for f in r.fields)) for r in rows]


def flat(found):
    return sorted((kind, type_ or "", key or "", tuple((n, tuple(p)) for n, p in fields.items())) for kind, type_, key, fields, _ in found)


@pytest.mark.parametrize("size", [700, 1 << 27])
def test_every_split_gives_the_same_entries(spark, tmp_path, size):
    texts = [library(seed, 20) for seed in (1, 2)] + ["", "no entry at all", "@article{only, title = {open\n@line\n"]
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.bib").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = entries_of(spark, tmp_path)
        kept = bibtex.ingest_bibtex(spark, str(tmp_path), schemas.BIBTEX, schemas.bibtex_items(spark))
        keys = [r.text for r in kept.values.filter("attr = 'id'").orderBy("key").collect()]
        journals = sorted((r.key, r.text) for r in kept.values.filter("attr = 'journal'").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [e for text in texts for e in expected(text)]
    assert sorted((k, t or "", c or "", f) for k, t, c, f in got) == flat(want)
    # Keys number the entries in the order of the files, and macros go by place.
    cited = [e[2] for e in want if e[0] == "entry"]
    assert keys == [c for c in cited if c is not None]
    if not hasattr(test_every_split_gives_the_same_entries, "journals"):
        test_every_split_gives_the_same_entries.journals = journals
    assert journals == test_every_split_gives_the_same_entries.journals


def test_an_entry_over_many_blocks(spark, tmp_path):
    body = "".join(f"\n@line {i}" for i in range(400))
    (tmp_path / "a.bib").write_text(f"@misc{{a, title = {{A}}}}\n@misc{{b, title = {{{body}\n}}}}\n@misc{{c, title = {{C}}}}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "800")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = entries_of(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [g[2] for g in got] == ["a", "b", "c"]
    assert got[1][3][0][1][0][1] == body + "\n"
