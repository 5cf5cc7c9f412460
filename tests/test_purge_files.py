"""Entries removed from BibTeX files: every byte that stays is compared, for any size of split."""

import glob
import os

import pytest

from folioframe.operators.purge import purge_files

KEEP = "kept"
# (text, key): a file is the concatenation; pieces with a key that is cited go with their line end.
PARTS = [
    ("Some words first, {with braces}\n% a comment\n\n", None),
    ("@string{jan2 = \"January\"}\n", None),
    ("@article{gone1,\n  title = {A {nested} title \\{ with a mark},\n  year = 1990\n}\n", "gone1"),
    ("\n\n", None),
    ("@book{stay1, title = \"é à 漢 𝄞\"}\n", "stay1"),
    ("  @misc{gone2, note={indented 𝄞}}\n", "gone2"),
    ("  @misc{stay2, note={indented}}\n", "stay2"),
    ("@article(gone3, title = {in (parentheses) and {braces}})\n", "gone3"),
    ("@comment{gone1, not an entry}\n", None),
    ("@article{gone4,\n  note = {lines\n@home{x}\n@ and more\n},\n abstract = {" + "long text \n" * 90 + "}}\n", "gone4"),
    ("@article{stay4,\n  note = {lines\n@home{x}\n@ and more\n},\n abstract = {" + "long text \n" * 90 + "}}\n", "stay4"),
    ("Text between.\r\n", None),
    ("@article{gone1, title = {again}}\n", "gone1"),
    ("@article{gone5, title = {\n@misc{gone6, x = {y}}}}\n", "gone5"),
    ("@article{stay5,}\n", "stay5"),
]
GONE = {f"gone{i}" for i in range(1, 6)}


def content(out: str, name: str) -> bytes:
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(os.path.join(out, f"file={name}", "part-*"))))


@pytest.mark.parametrize("split", ["300", "1500", "128m"])
def test_all_other_bytes_stay(spark, tmp_path, split):
    folder = tmp_path / "refs"
    folder.mkdir()
    files = {"a.bib": PARTS * 3, "b.bib": PARTS[::-1], "c.bib": PARTS[4:5]}
    for name, parts in files.items():
        (folder / name).write_bytes("".join(t for t, _ in parts).encode())
    cited = spark.createDataFrame([(k,) for k in [*GONE, "gone1", "nobody", None]], "citation_key string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        removed = purge_files(spark, str(folder), cited, str(tmp_path / "out"))
        rows = sorted((r.file, r.citation_key) for r in removed.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == sorted((n, k) for n, parts in files.items() for _, k in parts if k in GONE)
    for name, parts in files.items():
        assert content(str(tmp_path / "out"), name) == "".join(t for t, k in parts if k not in GONE).encode()


def test_what_never_closes_stays_and_a_last_line_is_ended(spark, tmp_path):
    folder = tmp_path / "refs"
    folder.mkdir()
    text = "@article{x, title = {open\n@article{y, a={b}}\n@article{x, a={b}}\n@article{z, a={b}} tail"
    (folder / "a.bib").write_text(text)
    cited = spark.createDataFrame([("x",), ("z",)], "citation_key string")
    purge_files(spark, str(folder), cited, str(tmp_path / "out"))
    assert content(str(tmp_path / "out"), "a.bib") == b"@article{x, title = {open\n@article{y, a={b}}\n tail\n"
    none = spark.createDataFrame([], "citation_key string")
    assert purge_files(spark, str(folder), none, str(tmp_path / "same")).count() == 0
    assert content(str(tmp_path / "same"), "a.bib") == (text + "\n").encode()


def test_files_of_one_name_are_refused(spark, tmp_path):
    for name in "ab":
        (tmp_path / "refs" / name).mkdir(parents=True)
        (tmp_path / "refs" / name / "x.bib").write_text("@misc{a, b={c}}\n")
    with pytest.raises(ValueError, match="x.bib"):
        purge_files(spark, str(tmp_path / "refs" / "*"), spark.createDataFrame([], "citation_key string"), str(tmp_path / "out"))
