import pytest
from conftest import items
from folioframe import model as m
from folioframe.functions import clean as c
from folioframe.functions import latex, names, style
from folioframe.operators import cite
from folioframe.plans import scan  # noqa: F401
from folioframe.sinks import bibliography as sink
from pyspark.sql import functions as F


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_names(spark):
    cases = {
        "Moreau, D.": ("D.", "Moreau"), "Nadal, J.-D.": ("J.-D.", "Nadal"), "Go{r}dy, F.": ("F.", "Gordy"),
        "Anna K. Weber": ("Anna K.", "Weber"), "J. Ellen B. Mills": ("J. Ellen B.", "Mills"), "Gordy F.": ("F.", "Gordy"),
        "{Conf Bidule}": (None, "Conf Bidule"), "A. Hansen.": ("A.", "Hansen"), "Peter Johan Van Cleve": ("Peter Johan", "Van Cleve"),
        "F.~Gordy": ("F.", "Gordy"), "Q. R.Ulman": ("Q. R.", "Ulman"), "Plato": (None, "Plato"), "Ann Bea Coe": ("Ann Bea", "Coe"),
        "Ann Bea Coe Dee": None, "a, b, c": None,
    }
    got = column(spark, list(cases), lambda t: names.read_person(t))
    for (raw, expected), r in zip(cases.items(), got):
        assert (r.person and (r.person.first, r.person.last)) == expected, raw


def test_name_lists(spark):
    got = column(spark, ["A B and {C and D} and and E", "X\nand Y"], names.split_names)
    assert got == [["A B", "{C and D}", "E"], ["X", "Y"]]


def test_initials(spark):
    got = column(spark, ["Jean-Daniel", "JD", "Anna Maria", "J.-D.", "", "JEAN"], names.initials)
    assert got == ["J.-D.", "J.D.", "A.M.", "J.-D.", None, "J."]


def test_latex(spark):
    plain = ["héß\u0010", "îï", "©æ", "a{b}%$\\", "ça Ñ €", "plain", ""]
    coded = column(spark, plain, latex.latex_encode)
    assert coded[:3] == ["h\\'e\\ss{}\\char16{}", '\\^{\\i}\\"{\\i}', "\\copyright{}\\ae{}"]
    assert column(spark, coded, latex.latex_decode) == plain
    assert column(spark, ["a \\char123 and a \\char125", "{{This} is \\{a\\}}", "\\'{e}\\c{c} \\'\\i"], latex.latex_decode) == [
        "a { and a }", "This is {a}", "éç í"]


def test_small_cleaners(spark):
    assert column(spark, ["10684-90", "5-7", "12", "99-01", "a-b", "1234-45"], c.expand_page_range) == ["10684-10690", "5-7", "12", "99-01", "a-b", "1234-1245"]
    assert column(spark, ["May", " dec ", "x"], c.month_number) == [5, 12, None]
    assert column(spark, ["c1998.", "12345", "1999 2001", "n.d."], c.parse_year) == [1998, 2345, 2001, None]
    assert column(spark, ["ISI:A1", "X:1", "A"], c.strip_source_prefix) == ["A1", None, None]
    dates = column(spark, ["1996", "1996/2/", "/3/4", "x/1"], c.parse_ris_date)
    assert [d and (d.year, d.month, d.day) for d in dates] == [(1996, None, None), (1996, 2, None), (None, 3, 4), None]
    assert column(spark, ["1-2", "7"], c.pages_label) == ["pages 1-2", "page 7"]


@pytest.fixture(scope="module")
def sample(spark):
    def record(key, authors=(), year=None, title=None, journal=None):
        return (key, [(None, f, l, None) for f, l in authors], year, title, journal)

    rows = [
        record(1, [("Frédéric", "Garner"), ("Géraldine", "Fabre")], 2006, "A title"), record(2, [("F.", "Garner")], 2006),
        record(3, [("Name", "Other")], 2006), record(4, year=2006), record(5, [("Fred", "Garner")]), record(6, journal="Sample <1>"),
    ]
    df = spark.createDataFrame(rows, f"key bigint, people array<{m.PERSON}>, year int, title string, journal string")
    text = lambda n: m.one(m.value("text", F.col(n)))
    return df.select(
        "key",
        m.attributes(
            author=F.transform("people", lambda p: m.value("person", p)), title=text("title"), journal=text("journal"),
            date=m.one(m.value("date", F.when(F.col("year").isNotNull(), m.partial_date(F.col("year"))))),
            doctype=m.one(m.value("txo", m.txo("doctype", F.lit(1)))),
        ).alias("attrs"),
    )


def cites(spark, uids):
    return spark.createDataFrame([("d", u, i) for i, u in enumerate(uids)], "doc string, uid bigint, at int")


def test_numeric_keys(spark):
    got = {r.uid: r.cite_key for r in cite.numeric_keys(cites(spark, [1, 2, 3, 2, 1])).collect()}
    assert got == {1: "1", 2: "2", 3: "3"}
    order = cite.document_order(cites(spark, [5, 3, 5, 9])).orderBy("pos").collect()
    assert [(r.uid, r.pos) for r in order] == [(5, 1), (3, 2), (9, 3)]


def test_alpha_keys(spark, sample):
    bases = cite.alpha_bases(sample)
    assert {r.uid: r.base for r in bases.collect()} == {1: "GF06", 2: "Gar06", 3: "Oth06", 4: "06", 5: "Gar", 6: "Unknown"}
    many = spark.range(1, 60).select(F.lit("d").alias("doc"), F.col("id").alias("uid"), F.col("id").alias("at"), F.lit("K").alias("base"))
    got = {r.uid: r.cite_key for r in cite.disambiguate(many).collect()}
    assert [got[i] for i in (1, 2, 3, 27, 28, 53, 54)] == ["K", "K:a", "K:b", "K:z", "K:aa", "K:az", "K:ba"]


def test_bibliography(spark, sample, tmp_path):
    types = items(spark, [("doctype", 1, None, "article")])
    rows = cite.reference_rows(sample, types)
    order = cite.document_order(cites(spark, [1, 6]))
    keyed = order.select("doc", "uid", F.col("pos").cast("string").alias("cite_key"))
    lines = sink.html_lines(cite.bibliography(order, keyed, rows, style.plain, style.html))
    path = str(tmp_path / "bib")
    sink.write(lines, path)
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "bib").glob("part-*")) if p.read_text())
    assert text == (
        "<table>\n<tr><td>[1]</td><td>Frédéric Garner and Géraldine Fabre. A title. 2006.</td></tr>\n"
        "<tr><td>[2]</td><td><i>Sample &lt;1&gt;</i>.</td></tr>\n</table>")


def test_rekey(spark):
    old, new = cite.numeric_keys(cites(spark, [1, 2, 3])), cite.numeric_keys(cites(spark, [2, 3]))
    assert sorted((r.uid, r.old_key, r.new_key) for r in cite.rekey_changed(old, new).collect()) == [(2, "2", "1"), (3, "3", "2")]


def test_accents_come_from_unicode(spark):
    coded = ["\\.e", "\\v{c}", "\\v c", "\\H{o}", "\\u{a}", "\\k{e}", "\\r{u}", "\\={o}", "\\d{s}", "\\'\\j", "\\v{q}", "\\bf x"]
    plain = ["ė", "č", "č", "ő", "ă", "ę", "ů", "ō", "ṣ", "j\u0301", "q\u030c", "bf x"]
    assert column(spark, coded, latex.latex_decode) == plain
    assert column(spark, column(spark, plain[:9], latex.latex_encode), latex.latex_decode) == plain[:9]
