import random

import pytest
from conftest import items, make_values
from folioframe import model as m
from folioframe import schemas
from folioframe.operators import adapt, enrich, tables
from folioframe.sinks import formats, lines, native_xml
from folioframe.sources import bibtex, tagged, xml_formats
from folioframe.sources import native_xml as native
from folioframe.sources.common import read_xml
from pyspark.sql import functions as F


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def shown(values, key=None):
    rows = values.select("key", "attr", "pos", m.payload_text().alias("v")).collect()
    return sorted((r.attr, r.pos, r.v) for r in rows if key is None or r.key == key)


def quals(values):
    rows = values.select("attr", F.explode("quals").alias("q")).select("attr", "q.name", "q.pos", m.payload_text("q").alias("v")).collect()
    return sorted(map(tuple, rows))


def broken(got):
    return sorted((r.rule, r.detail) for r in got.violations.collect())


def test_ris(spark, tmp_path):
    text = ("TY  - JOUR\r\nA1  - Adams,\r\n      Fred\r\nA1  - Baker,S.A.,Jr\r\nT1  - A title\r\n      that goes on\r\nY1  - 1996/04/\r\n"
            "KW  - one\r\nM1  - misc\r\nQQ  - odd\r\nVL  - 85\r\nER  - \r\n\r\nTY  - BOOK\r\nTI  - Second\r\nY1  - x\r\nER  - \r\n")
    got = tagged.ingest_ris(spark, write(tmp_path, "a.ris", text))
    assert shown(got.values, 1) == [
        ("author", 0, "|Fred|Adams|"), ("author", 1, "|S.A.|Baker|Jr"), ("date", 0, "1996-4-"), ("title", 0, "A title that goes on"), ("volume", 0, "85")]
    assert shown(got.values, 2) == [("title", 0, "Second")]
    assert broken(got) == [("unknown_tag", "QQ"), ("unreadable", "x")]
    assert [tuple(r) for r in got.log.collect()] == [("M1", 1)]
    assert sorted(map(tuple, got.result_set(4).collect())) == [(4, 1), (4, 2)]


def test_isi(spark, tmp_path):
    text = ("FN Export\nVR 1.0\nPT J\nAU Adams, F\n   Baker, S\n   The, Odd, One\nTI Long title\n   in two lines\nSO A JOURNAL\nJ9 AJ\nPY 2005\n"
            "ID KEY ONE; KEY TWO\nLA English\nBP 10\nEP 12\nUT ISI:0001\nER\n\nPT J\nTI Other\nVL 3\nER\nEF\n")
    got = tagged.ingest_isi(spark, write(tmp_path, "a.isi", text))
    assert shown(got.values, 1) == [
        ("author", 0, "|F|Adams|"), ("author", 1, "|S|Baker|"), ("author", 2, "||The, Odd, One|"), ("doctype", 0, "doctype/3"),
        ("keyword", 0, "KEY ONE"), ("keyword", 1, "KEY TWO"), ("source", 0, "A JOURNAL"), ("title", 0, "Long title\nin two lines"), ("ut", 0, "0001")]
    assert quals(got.values) == [("source", "abbrev", 0, "AJ"), ("source", "pages", 0, "10-12"), ("source", "year", 0, "2005")]
    assert broken(got) == [("incomplete", "source")]
    assert [tuple(r) for r in got.log.collect()] == [("LA", 1)]


BIB = r"""Some words outside.
@string{JV = "Journal of Vines"}
@comment{not {closed}
@Article{first,
  Author  = {Adams, {Leopold} and {\'E}mile  Zo and {Conf and Co}},
  Title   = {{This} is a {title} with {\"u}},
  Journal = JV # { 1st},
  month = may, year = 1999
  note    = {a \{ and a \char125},
  number  = 123 # { 456 }
}
  @book(second, title = "In {B}races ("quoted")", url = {http://host/~me/}, editor={A. Hansen.},)
@misc{third, title = {text
@ sign inside}, foo = {x}, year = {soon}}
@misc{open, title = {never closed
"""


def test_bibtex(spark, tmp_path):
    text = BIB.replace('("quoted")', "(quoted)").replace("\n@ sign", " sign")
    got = bibtex.ingest_bibtex(spark, write(tmp_path, "a.bib", text), schemas.BIBTEX, schemas.bibtex_items(spark))
    assert shown(got.values, 1) == [
        ("author", 0, "|Leopold|Adams|"), ("author", 1, "|Émile|Zo|"), ("author", 2, "||Conf and Co|"), ("date", 0, "1999-5-"),
        ("doctype", 0, "doctype/1"), ("id", 0, "first"), ("journal", 0, "Journal of Vines 1st"), ("note", 0, "a { and a }"),
        ("number", 0, "123 456 "), ("title", 0, "This is a title with ü")]
    assert shown(got.values, 2) == [
        ("doctype", 0, "doctype/2"), ("editor", 0, "|A.|Hansen|"), ("id", 0, "second"), ("title", 0, "In Braces (quoted)"), ("url", 0, "http://host/~me/")]
    assert shown(got.values, 3) == [("doctype", 0, "doctype/9"), ("id", 0, "third"), ("title", 0, "text sign inside")]
    assert [r for r, _ in broken(got)] == ["unbalanced", "unknown_attribute", "unreadable"]


def test_bibtex_export(spark, tmp_path):
    values = make_values(spark, [
        (1, "id", "id", "k1"), (1, "doctype", "txo", ("doctype", 1)), (1, "author", "person", (None, "Fred", "Adams", None)),
        (1, "author", "person", (None, None, "Conf", None)), (1, "title", "text", "Öl  and\n{x}"), (1, "date", "date", (2003, 2, None))])
    path = str(tmp_path / "out")
    lines.write(formats.bibtex_lines(values, schemas.bibtex_items(spark)), path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ('@article{k1,\n   author = {Adams, Fred\n             and {Conf}},\n   title  = {\\"Ol and \\char123{}x\\char125{}},\n   year   = 2003\n}\n')


MARC = """<?xml version="1.0"?><collection>
<record><controlfield tag="001">id1</controlfield><controlfield tag="005">skip</controlfield>
<datafield tag="245" ind1="" ind2=""><subfield code="a">T &amp; U</subfield></datafield>
<datafield tag="700" ind1="" ind2=""><subfield code="a">Adams, F.</subfield></datafield>
<datafield tag="700" ind1="" ind2=""><subfield code="a">A, b, c</subfield></datafield>
<datafield tag="856" ind1="4" ind2=""><subfield code="u">http://x/</subfield><subfield code="z">odd</subfield></datafield>
</record><record><controlfield tag="001">id2</controlfield></record></collection>"""


def test_marc(spark, tmp_path):
    mapping = {1: "id", (245, "", "", "a"): "title", (700, "", "", "a"): "author", (856, "4", "", "u"): "url"}
    got = xml_formats.ingest_marcxml(spark, write(tmp_path, "a.xml", MARC), mapping, schemas.BIBTEX)
    assert shown(got.values, 1) == [("author", 0, "|F.|Adams|"), ("id", 0, "id1"), ("title", 0, "T & U"), ("url", 0, "http://x/")]
    assert shown(got.values, 2) == [("id", 0, "id2")]
    assert broken(got) == [("unknown_field", "856|4||z"), ("unreadable", "A, b, c")]
    assert [tuple(r) for r in got.log.collect()] == [("5", 1)]


def test_endnote(spark, tmp_path):
    text = """<XML><RECORDS><RECORD><REFERENCE_TYPE>0</REFERENCE_TYPE><TITLE>Plain <style face="bold">bold</style></TITLE>
<AUTHORS><AUTHOR>Adams, Fred</AUTHOR><AUTHOR><style>Baker</style></AUTHOR></AUTHORS></RECORD></RECORDS></XML>"""
    got = xml_formats.ingest_endnote_xml(spark, write(tmp_path, "e.xml", text), {"TITLE": "title", "AUTHORS/AUTHOR": "author"}, schemas.BIBTEX)
    assert [v.strip() for _, _, v in shown(got.values)] == ["|Fred|Adams|", "||Baker|", "Plain bold"]


def test_wok_and_adapter(spark, tmp_path):
    text = """<RECS><REC><item><ut>u1</ut><authors><primaryauthor>A, S</primaryauthor><fullauthorname><AuLastName>Adams</AuLastName><AuFirstName>Sue</AuFirstName></fullauthorname><author>Baker, T</author><author>C</author><fullauthorname><AuLastName>Coe</AuLastName></fullauthorname></authors>
<corp_authors><corp_author>Acme</corp_author></corp_authors><abstract avail="N"><p>x</p></abstract><doctype code="Q">s</doctype>
<source_title>J &amp; K</source_title><item_title>T</item_title><bib_issue vol="7" year="1999"/><article_nos><article_no>DOI 10.1/x</article_no></article_nos></item></REC></RECS>"""
    got = xml_formats.ingest_wok_xml(spark, write(tmp_path, "w.xml", text), schemas.wok_items(spark))
    assert [v for a, _, v in shown(got.values) if a == "author"] == ["|Sue|Adams|", "|T|Baker|", "||Coe|", "||Acme|"]
    adapted = adapt.adapt_schema(got.values, "wok", "bibtex")
    assert [x for x in shown(adapted) if x[0] != "author"] == [
        ("date", 0, "1999--"), ("doctype", 0, "doctype/1"), ("id", 0, "u1"), ("journal", 0, "J & K"), ("title", 0, "T"), ("volume", 0, "7")]
    assert adapt.adapt_schema(adapted, "bibtex", "bibtex") is adapted
    with pytest.raises(adapt.NoAdapter):
        adapt.adapt_schema(adapted, "bibtex", "wok")


def test_native_round_trip(spark, tmp_path):
    values = make_values(spark, [
        (1, "author", "person", ("Dr", "É", 'O"Neil', None)), (1, "author", "person", (None, None, "Two", "Jr")), (1, "date", "date", (2003, None, 4)),
        (1, "id", "id", "He & he"), (1, "text", "text", " a <b>\n é "), (1, "url", "url", "http://x/?a=1&b=2"), (2, "kind", "txo", ("g", 3)), (2, "text", "text", "")])
    note = m.quals(m.qual("n", "text", F.lit("q<1>"), 0), m.qual("n", "text", F.lit("q2"), 1), m.qual("who", "person", m.person(F.lit("W"))))
    values = values.withColumn("quals", F.when(F.col("type").isin("text", "txo", "person"), note).otherwise(F.col("quals")))
    member = spark.createDataFrame([(1, 1), (1, 2), (5, 2)], "rs_id bigint, key bigint")
    meta = spark.createDataFrame([(1, "one"), (5, None)], "rs_id bigint, name string")
    path = str(tmp_path / "db")
    schema = m.Schema("s", {"text": m.Attribute("text", max_n=2, names={"": "Text", "fr": "Texte"}, quals={"n": m.Qualifier("text")}), "kind": m.Attribute("txo", grp="g")})
    native_xml.write_database(path, values, schema, member, meta, "About & more")
    got = native.ingest_native_xml(spark, f"{path}/entries")
    assert tables.diff_records(values, got.values).collect() == [] and broken(got) == []
    sets_, named = native.read_sets(spark, f"{path}/sets")
    assert sorted(map(tuple, sets_.collect())) == [(1, 1), (1, 2), (5, 2)] and sorted(map(tuple, named.collect())) == [(1, "one"), (5, None)]
    assert native.read_header(spark, f"{path}/header").first().header == "About & more"
    assert native.load_schema(spark, f"{path}/schema", "s") == schema
    checked = native.ingest_native_xml(spark, f"{path}/entries", schema)
    assert ("unknown_attribute", "author") in broken(checked) and ("unknown_qualifier", "who") in broken(checked)


def test_schema_files(spark, tmp_path):
    good = """<s><attribute id="a" type="txo" group="g"><name>A</name><qualifiers><attribute id="q" type="text"><name>Q</name></attribute></qualifiers></attribute>
<txo-group id="g"><txo-item id="1"><name lang="C">one</name><name>One</name><txo-item id="2"><name lang="C">two</name><txo-item id="3"><name>three</name></txo-item></txo-item></txo-item><txo-item id="4"><name>four</name></txo-item></txo-group></s>"""
    path = write(tmp_path, "s.xml", good)
    assert native.load_schema(spark, path).attrs["a"].quals["q"].type == "text"
    assert sorted((r.id, r.parent) for r in native.load_items(spark, path).collect()) == [(1, None), (2, 1), (3, 2), (4, None)]
    deep = "".join(f"<txo-item id='{i}'>\n<name lang='C'>level &amp; {i}</name>" for i in range(1, 41)) + "</txo-item>" * 40
    deep = f"<s><txo-group id='deep'>{deep}</txo-group><txo-group id='g'><txo-item id='1'><name>a</name></txo-item></txo-group></s>"
    found = {(r.grp, r.id): r for r in native.load_items(spark, write(tmp_path, "d.xml", deep)).collect()}
    assert len(found) == 41 and all(found["deep", i].parent == (i - 1 or None) for i in range(1, 41))
    assert found["deep", 7].names == {"C": "level & 7"} and found["g", 1].parent is None
    again = "<s><txo-group id='g'><txo-item id='1'><name lang='C'>a</name></txo-item><txo-item id='2'><name lang='C'>a</name></txo-item></txo-group></s>"
    with pytest.raises(m.SchemaError):
        native.load_items(spark, write(tmp_path, "again.xml", again))
    twice = write(tmp_path, "t.xml", '<s><attribute id="a" type="text"/><attribute id="a" type="url"/></s>')
    with pytest.raises(m.SchemaError):
        native.load_schema(spark, twice)


def test_items_round_trip(spark, tmp_path):
    tree = items(spark, [("g", 1, None, "one"), ("g", 10, 1, "ten & up"), ("g", 11, 10, "x"), ("g", 2, None, "two"), ("h", 1, None, "other")])
    path = str(tmp_path / "items")
    native_xml.write_items(native_xml.item_lines(tree), path)
    # a document needs a root: put one around the lines of a file
    text = "".join(p.read_text() for p in sorted((tmp_path / "items").glob("part-*")))
    got = native.load_items(spark, write(tmp_path, "items.xml", f"<s>{text}</s>"))
    assert sorted(map(tuple, got.select("grp", "id", "parent", F.col("names")["C"]).collect()), key=str) == sorted(
        map(tuple, tree.select("grp", "id", "parent", F.col("names")["C"]).collect()), key=str)


def test_root_element_is_first_and_last(spark, tmp_path):
    values = make_values(spark, [(k, "text", "text", "t") for k in range(1, 30)])
    path = str(tmp_path / "doc")
    lines.write(lines.document(native_xml.entry_lines(values), "<root>", "</root>"), path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert text.startswith('<root>\n <entry id="1">') and text.endswith(" </entry>\n</root>\n")
    assert native.ingest_native_xml(spark, path).values.count() == 29


def test_enrich(spark):
    coords = lambda df: df.select("k", *enrich.coordinates(*[F.col(c) for c in "tlvpy"]))
    ddl = "k string, t string, l string, v string, p string, y string"
    reference = coords(spark.createDataFrame([("d1", "The  Title!", "SU", "109", "23925", "2005"), ("d2", "Two", "A", "1", "1", "1"), ("d3", "two", "a", "1", "1", "1")], ddl))
    asked = coords(spark.createDataFrame([("1", "the title", "Su", "109", "23925", "2005"), ("2", "Two", "A", "1", "1", "1"), ("3", "None", "A", "1", "1", "1")], ddl))
    got = enrich.enrich_identifiers(asked.withColumnRenamed("k", "key"), reference.withColumnRenamed("k", "identifier"))
    assert {r.key: (r.n_hits, r.found) for r in got.collect()} == {"1": (1, "d1"), "2": (2, None), "3": (0, None)}
    assert tuple(enrich.statistics(got).first()) == (1, 1, 1)


def test_sets_in_any_layout(spark, tmp_path):
    text = """<db><resultset id="1" name='a &amp; "b"'><ref id="1"/><ref id="2"/></resultset><resultset id="2"><ref
 id="7"/></resultset>
<resultset name="empty" id="3"></resultset></db>"""
    member, meta = native.read_sets(spark, write(tmp_path, "sets.xml", text))
    assert sorted(map(tuple, member.collect())) == [(1, 1), (1, 2), (2, 7)]
    assert sorted(map(tuple, meta.collect())) == [(1, 'a & "b"'), (2, None), (3, "empty")]


def test_unreadable_names_leave_no_gap(spark, tmp_path):
    path = write(tmp_path, "odd.bib", "@article{k, author = {Aa Bb Cc Dd and, and John Smith and Eve Jones}, title = {T}}\n")
    kinds = schemas.bibtex_items(spark)
    got = bibtex.ingest_bibtex(spark, path, schemas.BIBTEX, kinds)
    authors = got.values.filter("attr = 'author'").select("pos", "person.last").collect()
    assert sorted(r.pos for r in authors) == list(range(len(authors)))
    text = [r.line.strip() for r in lines.ordered(formats.bibtex_lines(got.values, kinds)).collect()]
    assert sum(x.startswith("author") for x in text) == 1
    # The sinks do not rely on positions that start at 0 either.
    gaps = got.values.filter("attr <> 'author' OR pos > 0")
    text = [r.line.strip() for r in lines.ordered(formats.bibtex_lines(gaps, kinds)).collect()]
    assert sum(x.startswith("author") for x in text) == (len(authors) > 1)
    xml = "".join(r.line for r in lines.ordered(native_xml.entry_lines(gaps)).collect())
    assert xml.count("<attribute") == xml.count("</attribute>") > 0


def test_at_signs_in_fields_and_macros_by_place(spark, tmp_path):
    text = """@string{x = {Old}}
@article{a, title = x # { one}, note = {go
@home please
and {deep
@article{not, title = {here}}
} on}, year = 2001}
@string{x = {New}}
@article{b, title = X}
@article{open, title = {never closes}
@article{c, title = {after}}
"""
    kinds = schemas.bibtex_items(spark)
    got = bibtex.ingest_bibtex(spark, write(tmp_path, "at.bib", text), schemas.BIBTEX, kinds)
    names = {r.key: r.text for r in got.values.filter("attr = 'id'").collect()}
    titles = {names[r.key]: r.text for r in got.values.filter("attr = 'title'").collect()}
    assert titles == {"a": "Old one", "b": "New", "c": "after"}
    notes = [r.text for r in got.values.filter("attr = 'note'").collect()]
    assert len(notes) == 1 and "@home please" in notes[0]
    assert [r.rule for r in got.violations.filter("rule = 'unbalanced'").collect()] == ["unbalanced"]


def test_sets_skip_comments_and_sections_and_decode_references(spark, tmp_path):
    text = """<db><!-- <ref id="9"/> <resultset id="5" name="no"> -->
<t><![CDATA[ <!-- <ref id="8"/> ]]></t><resultset id="1" name="Ren&#233; &amp;#x41; &#x1F600; &#xD800; &nbsp;&lt;">
<!-- <![CDATA[ <ref id="7"/> --><ref id="1"/><!-- one <b> --><ref id="2"/><![CDATA[<ref id="6"/>]]>
</resultset><resultset id="2"><!--><ref id="3"/--><ref id="4"/> --> ]]> <ref id="5"/></resultset></db>"""
    text = text.replace("<!--><ref id=\"3\"/-->", "<!-- > <ref id=\"3\"/-->")
    member, meta = native.read_sets(spark, write(tmp_path, "sets.xml", text))
    assert sorted(tuple(r) for r in member.collect()) == [(1, 1), (1, 2), (2, 4), (2, 5)]
    assert {r.rs_id: r.name for r in meta.collect()} == {1: "René &#x41; \U0001f600 &#xD800; &nbsp;<", 2: None}


def test_sections_over_many_blocks_against_a_plain_reader(spark, tmp_path):
    """Random files with comments and sections, in blocks far smaller than they are."""
    pick = random.Random(11)
    want = set()
    for n in range(2):
        out = [f'<db><resultset id="{n}">']
        for key in range(900):
            tag = f'<ref id="{key}"/>'
            kind = pick.random()
            if kind < 0.3:
                out.append(f"<!-- {tag} {pick.choice(['', ']]>', '<![CDATA[', '<!-'])} {tag * pick.randint(0, 9)} -->")
            elif kind < 0.6:
                out.append(f"<![CDATA[ {tag} {pick.choice(['', '-->', '<!--', '<!-- -->'])} {tag * pick.randint(0, 9)} ]]>")
            else:
                out.append(tag)
                want.add((n, key))
        # The first file ends inside a comment.
        write(tmp_path, f"{n}.xml", "\n".join(out) + ("<!-- <ref id='1000'/>" if n == 0 else "</resultset></db>"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        member, _ = native.read_sets(spark, str(tmp_path))
        assert {tuple(r) for r in member.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_bibtex_writer_makes_its_values_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [(k, a, "id" if a == "id" else "text", f"{a}{k}") for k in range(1, 9) for a in ("id", "title", "journal")]
    values = make_values(spark, rows)
    values = values.mapInPandas(count, values.schema)
    text = [r.line for r in lines.ordered(formats.bibtex_lines(values, schemas.bibtex_items(spark))).collect()]
    assert text[:4] == ["@misc{id1,", "   journal = {journal1},", "   title   = {title1}", "}"] and len(text) == 32
    assert made.value == len(rows)


def test_xml_pieces_start_at_their_first_tag(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        "<?xml version='1.0'?><!-- \U0001d11e é --><recs>\n<record\n n='1'><a>x <![CDATA[<record >]]></a></record>"
        "<record><a>\U0001d11e</a></record> </recs><recordset><a>y</a></record>", encoding="utf-8"
    )
    got = read_xml(spark, str(tmp_path), "record", "_n string, a string").orderBy("_n").collect()
    assert [(r["_n"], r["a"]) for r in got] == [(None, "\U0001d11e"), ("1", "x <record >")]
