"""Exchange formats and schema adaptation.

The files are written by Spark from the shipped tables and read back, so that what a reader
finds can be compared with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m
from .. import schemas
from ..functions.names import last_first
from ..operators import adapt, purge
from ..session import scratch_path
from ..sinks import formats, lines, native_xml
from ..sources import bibtex as bibtex_source
from ..sources import native_xml as native_source
from ..sources import tagged, xml_formats
from . import bindings as b
from .registry import query

# Parts as SQL values in the BibTeX schema: key, attr, pos, value.
SQL_PARTS = """
a AS (SELECT *, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) AS f,
             upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS l,
             'B' || substr(p_brand, 7) AS br, left(p_type, 1) || lower(substr(p_type, 2)) AS ty FROM part),
vals AS (
  SELECT p_partkey + 1 AS key, 'id' AS attr, 0 AS pos, 'part' || p_partkey AS value FROM a
  UNION ALL SELECT p_partkey + 1, 'doctype', 0, 'doctype/' || CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'PROMO' THEN 7
      WHEN 'LARGE' THEN 9 WHEN 'MEDIUM' THEN 12 ELSE 13 END FROM a
  UNION ALL SELECT p_partkey + 1, 'author', 0, '|' || f || '|' || l || '|' FROM a WHERE p_size % 4 >= 1
  UNION ALL SELECT p_partkey + 1, 'author', 1, '|' || br || '|' || ty || '|' FROM a WHERE p_size % 4 >= 2
  UNION ALL SELECT p_partkey + 1, 'author', 2, '|' || ty || '|' || br || '|' FROM a WHERE p_size % 4 >= 3
  UNION ALL SELECT p_partkey + 1, 'title', 0, p_brand || ' & ' || p_name FROM a
  UNION ALL SELECT p_partkey + 1, 'journal', 0, 'Journal of ' || f || ' ' || l FROM a WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey + 1, 'volume', 0, CAST(p_size AS VARCHAR) FROM a WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey + 1, 'number', 0, CAST(p_size - 25 AS VARCHAR) FROM a WHERE p_type = 'ECONOMY' AND p_size > 25
  UNION ALL SELECT p_partkey + 1, 'pages', 0, p_partkey || '-' || (p_partkey + p_size) FROM a WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey + 1, 'date', 0, (2000 + p_size % 2) || '--' FROM a WHERE p_size <> 7 AND p_size % 8 <> 4)"""


def shown(values: DataFrame) -> DataFrame:
    return values.select("key", "attr", "pos", m.payload_text().alias("value"))


def with_quals(values: DataFrame) -> DataFrame:
    """Values and qualifiers as lines; a qualifier is ``attr.name`` at the place of its value."""
    q = values.select("key", "attr", "pos", F.explode("quals").alias("_q"))
    q = q.select("key", F.concat_ws(".", "attr", "_q.name").alias("attr"), "pos", m.payload_text("_q").alias("value"))
    return shown(values).unionByName(q)


def _write_pieces(rows: DataFrame, key: str, text: Column, path: str) -> None:
    """One piece of text per row, in key order over the files."""
    pieces = rows.select(F.col(key).alias("_key"), text.alias("value"))
    pieces.repartitionByRange("_key").sortWithinPartitions("_key").select("value").write.text(path)


def _part_values(spark, sf):
    return m.to_values(b.part_records(spark, sf))


def _string(name: str) -> Column:
    return F.col(name).cast("string")


def _joined(*parts) -> Column:
    """Text from parts; a missing part leaves out nothing but itself."""
    return F.concat(*[F.coalesce(F.lit(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def _line(text: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), text, F.lit(after))


# --- BibTeX ---------------------------------------------------------------------------------


def _bibtex_path(spark, sf) -> str:
    path = scratch_path(spark, "bibtex")
    lines.write(formats.bibtex_lines(_part_values(spark, sf), b.doctype_items(spark)), path)
    return path


@query(f"WITH {SQL_PARTS} SELECT key, attr, pos, value FROM vals")
def ingest_bibtex(spark, sf):
    """Exported and read again: everything comes back, with the same keys."""
    got = bibtex_source.ingest_bibtex(spark, _bibtex_path(spark, sf), schemas.BIBTEX, schemas.bibtex_items(spark))
    return shown(got.values)


def _sql_bibtex(title: str) -> str:
    """Every line of the entries; ``title`` is what becomes of a title."""
    return f"""WITH {SQL_PARTS}, s AS (
    SELECT key, CASE attr WHEN 'date' THEN 'year' ELSE attr END AS field, pos,
           CASE attr WHEN 'date' THEN split_part(value, '-', 1) WHEN 'title' THEN {title} WHEN 'author' THEN
             CASE split_part(value, '|', 2) WHEN '' THEN '{{' || split_part(value, '|', 3) || '}}'
             ELSE split_part(value, '|', 3) || ', ' || split_part(value, '|', 2) END ELSE value END AS text
    FROM vals WHERE attr NOT IN ('id', 'doctype')),
w AS (SELECT *, max(field) OVER (PARTITION BY key) AS final, CAST(max(length(field)) OVER (PARTITION BY key) AS INTEGER) AS width,
             max(pos) OVER (PARTITION BY key, field) AS last_pos FROM s)
SELECT p_partkey + 1 AS key, '@' || CASE p_type WHEN 'ECONOMY' THEN 'article' WHEN 'SMALL' THEN 'book' WHEN 'PROMO' THEN 'manual'
    WHEN 'LARGE' THEN 'misc' WHEN 'MEDIUM' THEN 'techreport' ELSE 'unpublished' END || '{{part' || p_partkey || ',' AS line FROM part
UNION ALL SELECT key, CASE WHEN pos = 0 THEN '   ' || rpad(field, width, ' ') || ' = ' || CASE field WHEN 'year' THEN '' ELSE '{{' END
        ELSE repeat(' ', width + 7) || 'and ' END || text
    || CASE WHEN pos = last_pos THEN CASE field WHEN 'year' THEN '' ELSE '}}' END || CASE field WHEN final THEN '' ELSE ',' END ELSE '' END FROM w
UNION ALL SELECT p_partkey + 1, '}}' FROM part"""


@query(f"""SELECT line FROM ({_sql_bibtex("value")})
    WHERE key NOT IN (SELECT l_partkey + 1 FROM lineitem WHERE l_quantity > 45)""")
def purge_bibtex_files(spark, sf):
    """Every line of the files that are left, after the entries of some citation keys have gone."""
    out = scratch_path(spark, "purged")
    large = b.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 45)
    cited = large.select(F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("citation_key"))
    purge.purge_files(spark, _bibtex_path(spark, sf), cited, out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@query(_sql_bibtex("value"))
def export_bibtex(spark, sf):
    """Every line of every entry, as written."""
    return formats.bibtex_lines(_part_values(spark, sf), b.doctype_items(spark)).select("key", "line")


@query(_sql_bibtex("upper(value) || '.'"))
def writer_field_hooks(spark, sf):
    """A writer that changes a field on its way out."""
    hooks = {"title": lambda text: F.concat(F.upper(text), F.lit("."))}
    return formats.bibtex_lines(_part_values(spark, sf), b.doctype_items(spark), hooks=hooks).select("key", "line")


@query(f"""WITH {SQL_PARTS} SELECT key, attr, pos, value FROM vals WHERE key - 1 NOT IN (
            SELECT p_partkey FROM part WHERE p_type = 'LARGE') AND attr <> 'title'
          UNION ALL SELECT key, attr, pos, upper(value) FROM vals WHERE attr = 'title' AND key - 1 NOT IN (
            SELECT p_partkey FROM part WHERE p_type = 'LARGE')""")
def reader_writer_hooks(spark, sf):
    """A writer that leaves records out, and a reader that changes a field."""
    values = _part_values(spark, sf)
    wanted = b.table(spark, sf, "part").filter(F.col("p_type") != "LARGE").select((F.col("p_partkey") + 1).alias("key"))
    path = scratch_path(spark, "hooks")
    lines.write(formats.bibtex_lines(values, b.doctype_items(spark), keep=wanted), path)
    got = bibtex_source.ingest_bibtex(
        spark, path, schemas.BIBTEX, schemas.bibtex_items(spark), hooks={"title": lambda raw: F.upper(raw)}
    )
    # keys are consecutive again after the gaps; the id tells which part it was
    ids = got.values.filter((F.col("attr") == "id")).select("key", (F.substring("text", 5, 20).cast("bigint") + 1).alias("part"))
    return shown(got.values).join(ids, "key").select(F.col("part").alias("key"), "attr", "pos", "value")


@query(f"WITH {SQL_PARTS} SELECT DISTINCT CAST(7 AS BIGINT) AS rs_id, key FROM vals")
def import_result_set(spark, sf):
    got = bibtex_source.ingest_bibtex(spark, _bibtex_path(spark, sf), schemas.BIBTEX, schemas.bibtex_items(spark))
    return got.result_set(7)


# --- RIS and ISI ----------------------------------------------------------------------------

def _ris_path(spark, sf) -> str:
    """Parts as RIS with CR LF: a continued title, unsupported and unknown tags."""
    rec = b.part_records(spark, sf).select("key", "attrs")
    part = b.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("key"), "p_brand", "p_name", "p_size", "p_type")
    rows = rec.join(part, "key")
    nl = "\r\n"
    people = F.array_join(
        F.transform(m.get_field("author"), lambda v: F.concat(F.lit("A1  - "), v["person"]["last"], F.lit(","), v["person"]["first"], F.lit(nl))), ""
    )
    one = lambda n: m.one_value(n)["text"]
    text = _joined(
        "TY  - JOUR" + nl, people, _line(F.col("p_brand"), "T1  - ", nl), _line(F.col("p_name"), "      ", nl),
        _line(one("journal"), "JO  - ", nl), _line(m.one_value("date")["date"]["year"].cast("string"), "Y1  - ", "/02/" + nl),
        _line(one("volume"), "VL  - ", nl), "SP  - 1" + nl, "KW  - metal" + nl,
        F.when(F.col("p_type") == "SMALL", "M1  - 3" + nl), F.when(F.col("p_type") == "PROMO", "ZZ  - 4" + nl),
        _line(one("id"), "ID  - ", nl), "ER  - \r",
    )
    path = scratch_path(spark, "ris")
    _write_pieces(rows, "key", text, path)
    return path


@query(f"""WITH {SQL_PARTS}
  SELECT key, attr, pos, value FROM vals WHERE attr IN ('id', 'author', 'journal', 'volume')
  UNION ALL SELECT key, attr, pos, replace(value, ' & ', ' ') FROM vals WHERE attr = 'title'
  UNION ALL SELECT key, attr, pos, replace(value, '--', '-2-') FROM vals WHERE attr = 'date'""")
def ingest_ris(spark, sf):
    return shown(tagged.ingest_ris(spark, _ris_path(spark, sf)).values)


@query("""SELECT 'log' AS kind, 'M1' AS tag, count(*) AS n FROM part WHERE p_type = 'SMALL'
          UNION ALL SELECT 'unknown_tag', 'ZZ', count(*) FROM part WHERE p_type = 'PROMO'""")
def import_log(spark, sf):
    """Tags that were left out, and tags nobody knows."""
    got = tagged.ingest_ris(spark, _ris_path(spark, sf))
    wrong = got.violations.groupBy(F.col("rule").alias("kind"), F.col("detail").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return got.log.select(F.lit("log").alias("kind"), "tag", "n").unionByName(wrong)


@query(f"""WITH {SQL_PARTS}
  SELECT key, attr, pos, value FROM vals WHERE attr = 'author'
  UNION ALL SELECT p_partkey + 1, 'ut', 0, 'part' || p_partkey FROM part
  UNION ALL SELECT p_partkey + 1, 'doctype', 0, 'doctype/3' FROM part
  UNION ALL SELECT p_partkey + 1, 'title', 0, p_brand || chr(10) || p_name FROM part
  UNION ALL SELECT p_partkey + 1, 'keyword', 0, p_type FROM part
  UNION ALL SELECT p_partkey + 1, 'keyword', 1, p_brand FROM part
  UNION ALL SELECT key, 'source', pos, value FROM vals WHERE attr = 'journal'
  UNION ALL SELECT key, 'source.volume', pos, value FROM vals WHERE attr = 'volume'
  UNION ALL SELECT key, 'source.number', pos, value FROM vals WHERE attr = 'number'
  UNION ALL SELECT p_partkey + 1, 'source.abbrev', 0, p_name FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT p_partkey + 1, 'source.issn', 0, '1234-' || p_size FROM part WHERE p_type = 'ECONOMY'
  UNION ALL SELECT key, 'source.pages', pos, value FROM vals WHERE attr = 'pages'
  UNION ALL SELECT v.key, 'source.year', 0, left(value, 4) FROM vals v JOIN part ON p_partkey + 1 = v.key
            WHERE attr = 'date' AND p_type = 'ECONOMY'""")
def ingest_isi(spark, sf):
    return with_quals(tagged.ingest_isi(spark, _isi_path(spark, sf)).values)


def _isi_path(spark, sf) -> str:
    rec = b.part_records(spark, sf)
    part = b.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("key"), "p_partkey", "p_brand", "p_name", "p_size", "p_type")
    rows = rec.join(part, "key")
    one = lambda n: m.one_value(n)["text"]
    names = F.transform(m.get_field("author"), lambda v: last_first(v["person"]))
    year = m.one_value("date")["date"]["year"].cast("string")
    article = one("journal").isNotNull()
    about = _joined(
        _line(one("journal"), "SO ", "\n"), _line(F.col("p_name"), "JI ", "\n"), _line(year, "PY ", "\n"),
        _line(one("volume"), "VL ", "\n"), _line(one("number"), "IS ", "\n"), _line(_string("p_size"), "SN 1234-", "\n"),
        _line(_string("p_partkey"), "BP ", "\n"), _line((F.col("p_partkey") + F.col("p_size")).cast("string"), "EP ", "\n"),
    )
    text = _joined(
        "PT J\n", _line(F.array_join(names, "\n   "), "AU ", "\n"), _line(F.col("p_brand"), "TI ", "\n"), _line(F.col("p_name"), "   ", "\n"),
        F.when(article, about), F.concat(F.lit("ID "), F.col("p_type"), F.lit("; "), F.col("p_brand"), F.lit("\n")),
        "LA English\n", _line(one("id"), "UT ISI:", "\n"), "ER\n",
    )
    path = scratch_path(spark, "isi")
    _write_pieces(rows, "key", text, path)
    return path


# --- XML formats ----------------------------------------------------------------------------


@query(f"""WITH {SQL_PARTS} SELECT key, attr, pos, value FROM vals
           UNION ALL SELECT key, 'title.note', 0, value || ' <' || attr || '>' FROM vals WHERE attr = 'volume'""")
def ingest_native_xml(spark, sf):
    """Exported in the native format, with a qualifier on some titles, and read again."""
    note = F.when(F.col("p_type") == "ECONOMY", F.concat(_string("p_size"), F.lit(" <volume>")))
    part = b.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("key"), m.quals(m.qual("note", "text", note)).alias("_n"))
    values = _part_values(spark, sf).join(part, "key")
    values = values.withColumn("quals", F.when(F.col("attr") == "title", F.col("_n")).otherwise(F.col("quals"))).drop("_n")
    path = scratch_path(spark, "native")
    lines.write(native_xml.entry_lines(values), path)
    return with_quals(native_source.ingest_native_xml(spark, path).values)


@query(f"""WITH {SQL_PARTS} SELECT key, attr AS field, count(*) + 2 AS n_lines FROM vals GROUP BY key, attr
           UNION ALL SELECT DISTINCT key, '', 2 FROM vals""")
def export_native_xml(spark, sf):
    """Lines per field of each entry, as written: the values, and the lines around them."""
    written = native_xml.entry_lines(_part_values(spark, sf))
    return written.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""WITH places AS (
            SELECT 1 AS d, r_regionkey + 1 AS id, r_name AS name FROM region
            UNION ALL SELECT 2, n_nationkey + 100, n_name FROM nation UNION ALL SELECT 3, c_custkey + 1000, c_name FROM customer)
          SELECT repeat(' ', d + 1) || '<txo-item id="' || id || '">' || chr(10) || repeat(' ', d + 1) || ' <name lang="C">' || name || '</name>' AS line FROM places
          UNION ALL SELECT repeat(' ', d + 1) || '</txo-item>' FROM places
          UNION ALL SELECT ' <txo-group id="geo">' UNION ALL SELECT ' </txo-group>'""")
def export_taxonomy(spark, sf):
    """The tree of places as nested elements, one row per line."""
    return native_xml.item_lines(b.geo_items(spark, sf)).select("line")


@query("""SELECT CAST(1 AS BIGINT) AS rs_id, 'english' AS name, doc_id + 1 AS key FROM documents WHERE lang = 'en'
          UNION ALL SELECT 2, 'labelled', doc_id + 1 FROM labels""")
def ingest_native_sets(spark, sf):
    """Result sets written and read line by line."""
    from ..operators import sets

    member = sets.of(b.doc_keys_in(spark, sf, "en"), 1).union(sets.of(b.labelled_keys(spark, sf), 2))
    meta = spark.createDataFrame([(1, "english"), (2, "labelled")], "rs_id bigint, name string")
    path = scratch_path(spark, "sets")
    native_xml.write_sets(native_xml.set_lines(member, meta), path)
    found, named = native_source.read_sets(spark, path)
    return found.join(named, "rs_id").select("rs_id", "name", "key")


MARC_FIELDS = {1: "id", ("245", "", "", "a"): "title", ("700", "", "", "a"): "author", ("773", "", "", "p"): "journal",
               ("260", "", "", "c"): "date", ("999", "", "", "x"): None}
MARC_MAPPING = {(k if isinstance(k, int) else (int(k[0]), *k[1:])): v for k, v in MARC_FIELDS.items()}


def _marc_cells(spark, sf):
    values = _part_values(spark, sf)
    code = F.lit(None).cast("string")
    for name, c in (("id", "001"), ("title", "245__"), ("author", "700__"), ("journal", "773__"), ("date", "260__"), ("volume", "999__")):
        code = F.when(F.col("attr") == name, F.lit(c)).otherwise(code)
    sub = F.when(F.col("attr") == "journal", "p").when(F.col("attr") == "date", "c").when(F.col("attr") == "volume", "x").otherwise("a")
    text = F.when(F.col("type") == "person", last_first(F.col("person"))).when(
        F.col("type") == "date", F.concat(F.lit("Bern, c"), F.col("date.year").cast("string"), F.lit("."))
    ).otherwise(F.col("text"))
    cells = values.select("key", code.alias("code"), F.col("pos").alias("n"), sub.alias("sub"), F.lit(0).alias("pos"), text.alias("text"))
    return cells.filter(F.col("code").isNotNull())


@query(f"WITH {SQL_PARTS} SELECT key, attr, pos, value FROM vals WHERE attr IN ('id', 'title', 'author', 'journal', 'date')")
def ingest_marcxml(spark, sf):
    path = scratch_path(spark, "marc")
    lines.write(formats.marcxml_lines(_marc_cells(spark, sf)), path)
    return shown(xml_formats.ingest_marcxml(spark, path, MARC_MAPPING, schemas.BIBTEX).values)


@query(f"""WITH {SQL_PARTS} SELECT key, CAST(sum(CASE attr WHEN 'id' THEN 1 ELSE 3 END) + 2 AS BIGINT) AS n_lines FROM vals
           WHERE attr IN ('id', 'title', 'author', 'journal', 'date', 'volume') GROUP BY key""")
def export_marcxml(spark, sf):
    """Lines per record: one per control field, three per data field with one subfield."""
    return formats.marcxml_lines(_marc_cells(spark, sf)).groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"))


ENDNOTE_FIELDS = {"title": "TITLE", "author": "AUTHORS/AUTHOR", "journal": "SECONDARY_TITLE", "pages": "PAGES"}


def _endnote_lines(spark, sf):
    types = b.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("key"), F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1).alias("reftype"))
    values = _part_values(spark, sf)
    marked = values.withColumn("text", F.when(F.col("attr") == "title", F.concat("text", F.lit(" é€"))).otherwise(F.col("text")))
    return formats.endnote_xml_lines(marked, ENDNOTE_FIELDS, types)


@query(f"""WITH {SQL_PARTS} SELECT key, attr, pos, value || CASE attr WHEN 'title' THEN ' é€' ELSE '' END AS value FROM vals
           WHERE attr IN ('title', 'author', 'journal', 'pages')""")
def ingest_endnote_xml(spark, sf):
    path = scratch_path(spark, "endnote")
    lines.write(_endnote_lines(spark, sf), path)
    mapping = {target: field for field, target in ENDNOTE_FIELDS.items()}
    return shown(xml_formats.ingest_endnote_xml(spark, path, mapping, schemas.BIBTEX).values)


@query(f"""WITH {SQL_PARTS} SELECT key, '<TITLE>' || replace(value, '&', '&amp;') || ' &#xE9;&#x20AC;</TITLE>' AS line FROM vals WHERE attr = 'title'""")
def export_endnote_xml(spark, sf):
    return _endnote_lines(spark, sf).filter(F.col("line").startswith("<TITLE>")).select("key", "line")


def _escaped(c: Column) -> Column:
    return lines.escape(c)


def _pubmed_path(spark, sf) -> str:
    part = b.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("key"), "p_partkey", "p_size", "p_type")
    rows = b.part_records(spark, sf).join(part, "key")
    one = lambda n: m.one_value(n)["text"]
    people = F.array_join(
        F.transform(
            m.get_field("author"),
            lambda v: F.concat(F.lit("<Author><LastName>"), v["person"]["last"], F.lit("</LastName><ForeName>"), v["person"]["first"], F.lit("</ForeName></Author>")),
        ), "",
    )
    year = m.one_value("date")["date"]["year"].cast("string")
    named = F.when(F.col("p_size") <= 25, _line(one("journal"), "<Title>", "</Title>"))
    journal = _joined(
        "<Journal>", _line(_string("p_size"), "<ISSN IssnType=\"Print\">12-", "</ISSN>"), "<JournalIssue>", _line(one("volume"), "<Volume>", "</Volume>"),
        "<PubDate>", _line(year, "<Year>", "</Year>"), "</PubDate></JournalIssue>", named, "</Journal>",
    )
    pages = F.concat((F.col("p_partkey") + 10000).cast("string"), F.lit("-99"))
    text = _joined(
        "<PubmedArticle><MedlineCitation Status=\"x\">", _line(one("id"), "<PMID Version=\"1\">", "</PMID>"), "<Article>",
        F.when(one("journal").isNotNull(), journal), _line(_escaped(one("title")), "<ArticleTitle>", "</ArticleTitle>"),
        _line(pages, "<Pagination><MedlinePgn>", "</MedlinePgn></Pagination>"),
        _line(people, "<AuthorList>", "</AuthorList>"), "</Article><MedlineJournalInfo><MedlineTA>Short</MedlineTA></MedlineJournalInfo>",
        "</MedlineCitation></PubmedArticle>",
    )
    path = scratch_path(spark, "pubmed")
    _write_pieces(rows, "key", text, path)
    return path


_PUBMED_VALUES = f"""{SQL_PARTS},
pp AS (SELECT p_partkey + 1 AS key, p_size, p_type, CAST(10000 + p_partkey AS VARCHAR) AS start FROM part),
pm AS (
  SELECT key, CASE attr WHEN 'id' THEN 'pmid' ELSE attr END AS attr, pos, value FROM vals WHERE attr IN ('id', 'title', 'author')
  UNION ALL SELECT pp.key, 'journal', 0, CASE WHEN p_size <= 25 AND p_type = 'ECONOMY' THEN value ELSE 'Short' END
    FROM pp LEFT JOIN vals v ON v.key = pp.key AND attr = 'journal'
  UNION ALL SELECT key, 'journal.issn', 0, '12-' || p_size FROM pp WHERE p_type = 'ECONOMY'
  UNION ALL SELECT key, 'journal.volume', 0, value FROM vals WHERE attr = 'volume'
  UNION ALL SELECT v.key, 'journal.year', 0, left(value, 4) FROM vals v JOIN pp USING (key) WHERE attr = 'date' AND p_type = 'ECONOMY'
  UNION ALL SELECT key, 'journal.pages', 0, start || '-' || CASE WHEN right(start, 2) < '99' THEN left(start, length(start) - 2) || '99' ELSE '99' END FROM pp)"""


@query(f"WITH {_PUBMED_VALUES} SELECT key, attr, pos, value FROM pm")
def ingest_pubmed_xml(spark, sf):
    got = xml_formats.ingest_pubmed_xml(spark, _pubmed_path(spark, sf)).values
    return with_quals(got)


@query(f"""WITH {_PUBMED_VALUES}
  SELECT key, CASE attr WHEN 'pmid' THEN 'id' ELSE attr END AS attr, pos, value FROM pm WHERE attr IN ('pmid', 'title', 'author', 'journal')
  UNION ALL SELECT key, 'doctype', 0, 'doctype/1' FROM pm WHERE attr = 'pmid'
  UNION ALL SELECT key, 'volume', 0, value FROM pm WHERE attr = 'journal.volume'
  UNION ALL SELECT key, 'pages', 0, value FROM pm WHERE attr = 'journal.pages'
  UNION ALL SELECT key, 'date', 0, value || '--' FROM pm WHERE attr = 'journal.year'""")
def pubmed_to_bibtex(spark, sf):
    values = xml_formats.ingest_pubmed_xml(spark, _pubmed_path(spark, sf)).values
    return shown(adapt.adapt_schema(values, "pubmed", "bibtex"))


@query(f"""WITH {_PUBMED_VALUES}, out AS (
  SELECT key, CASE attr WHEN 'pmid' THEN 'id' ELSE attr END AS attr, pos, value FROM pm WHERE attr IN ('pmid', 'title', 'author', 'journal')
  UNION ALL SELECT key, 'doctype', 0, 'doctype/1' FROM pm WHERE attr = 'pmid'
  UNION ALL SELECT key, 'volume', 0, value FROM pm WHERE attr = 'journal.volume'
  UNION ALL SELECT key, 'pages', 0, value FROM pm WHERE attr = 'journal.pages'
  UNION ALL SELECT key, 'date', 0, value || '--' FROM pm WHERE attr = 'journal.year') SELECT * FROM out""")
def convert_collection(spark, sf):
    """PubMed files to BibTeX files: read, adapt, write; and read once more to look at them."""
    values = xml_formats.ingest_pubmed_xml(spark, _pubmed_path(spark, sf)).values
    path = scratch_path(spark, "converted")
    lines.write(formats.bibtex_lines(adapt.adapt_schema(values, "pubmed", "bibtex"), schemas.bibtex_items(spark)), path)
    return shown(bibtex_source.ingest_bibtex(spark, path, schemas.BIBTEX, schemas.bibtex_items(spark)).values)


def _wok_path(spark, sf) -> str:
    part = b.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("key"), "p_partkey", "p_size", "p_type", "p_name")
    rows = b.part_records(spark, sf).join(part, "key")
    one = lambda n: m.one_value(n)["text"]
    # The first author also has a full name; the others only a short one.
    people = F.array_join(
        F.transform(
            m.get_field("author"),
            lambda v, n: F.concat(
                F.when(n == 0, "<primaryauthor>").otherwise("<author>"),
                F.when(n == 0, "short, s").otherwise(last_first(v["person"])),
                F.when(n == 0, "</primaryauthor>").otherwise("</author>"),
                F.when(
                    n == 0,
                    F.concat(F.lit("<fullauthorname><AuLastName>"), v["person"]["last"], F.lit("</AuLastName><AuFirstName>"), v["person"]["first"], F.lit("</AuFirstName></fullauthorname>")),
                ).otherwise(""),
            ),
        ), "",
    )
    year = m.one_value("date")["date"]["year"].cast("string")
    text = _joined(
        "<item>", _line(one("id"), "<ut>", "</ut>"), _line(people, "<authors>", "</authors>"),
        "<refs><ref>r1</ref><ref>r2</ref></refs><keywords><keyword>", F.col("p_type"), "</keyword></keywords>",
        F.when(F.col("p_size") <= 25, "<abstract avail=\"Y\"><p>one</p><p>two</p></abstract>").otherwise("<abstract avail=\"N\"><p>no</p></abstract>"),
        "<doctype code=\"@\">Article</doctype>", _line(one("journal"), "<source_title>", "</source_title>"), _line(_escaped(one("title")), "<item_title>", "</item_title>"),
        F.when(one("journal").isNotNull(), _joined(
            _line(one("pages"), "<bib_pages begin=\"1\">", "</bib_pages>"), "<bib_issue vol=\"", one("volume"), "\" year=\"", year, "\"/>")),
        _line(_string("p_partkey"), "<article_nos><article_no>DOI 10.1/", "</article_no><article_no>ARTN 7</article_no></article_nos>"), "</item>",
    )
    path = scratch_path(spark, "wok")
    _write_pieces(rows, "key", text, path)
    return path


_WOK_VALUES = f"""{SQL_PARTS},
wk AS (
  SELECT key, CASE attr WHEN 'id' THEN 'ut' WHEN 'journal' THEN 'source' ELSE attr END AS attr, pos, value FROM vals
  WHERE attr IN ('id', 'author', 'title', 'journal')
  UNION ALL SELECT p_partkey + 1, 'ref', CAST(i AS INTEGER), 'r' || (i + 1) FROM part, range(2) t(i)
  UNION ALL SELECT p_partkey + 1, 'keyword', 0, p_type FROM part
  UNION ALL SELECT p_partkey + 1, 'abstract', 0, 'one' || chr(10) || 'two' FROM part WHERE p_size <= 25
  UNION ALL SELECT p_partkey + 1, 'doctype', 0, 'doctype/3' FROM part
  UNION ALL SELECT p_partkey + 1, 'doi', 0, '10.1/' || p_partkey FROM part
  UNION ALL SELECT key, 'source.' || attr, 0, value FROM vals WHERE attr IN ('volume', 'pages')
  UNION ALL SELECT v.key, 'source.year', 0, left(value, 4) FROM vals v JOIN part ON p_partkey + 1 = v.key WHERE attr = 'date' AND p_type = 'ECONOMY')"""


@query(f"WITH {_WOK_VALUES} SELECT key, attr, pos, value FROM wk")
def ingest_wok_xml(spark, sf):
    got = xml_formats.ingest_wok_xml(spark, _wok_path(spark, sf), schemas.wok_items(spark))
    return with_quals(got.values)


@query(f"""WITH {_WOK_VALUES}
  SELECT key, CASE attr WHEN 'ut' THEN 'id' WHEN 'source' THEN 'journal' ELSE attr END AS attr, pos, value FROM wk
  WHERE attr IN ('ut', 'title', 'author', 'abstract', 'source')
  UNION ALL SELECT key, 'doctype', 0, 'doctype/1' FROM wk WHERE attr = 'doctype'
  UNION ALL SELECT key, substr(attr, 8), 0, value FROM wk WHERE attr IN ('source.volume', 'source.pages')
  UNION ALL SELECT key, 'date', 0, value || '--' FROM wk WHERE attr = 'source.year'""")
def wok_to_bibtex(spark, sf):
    values = xml_formats.ingest_wok_xml(spark, _wok_path(spark, sf), schemas.wok_items(spark)).values
    return shown(adapt.adapt_schema(values, "wok", "bibtex"))


@query("""SELECT doc_id + 1 AS key, 'headline' AS attr, split_part(text, chr(10), 1) AS value FROM documents
          UNION ALL SELECT doc_id + 1, 'origin', source FROM documents""")
def adapt_one_to_one(spark, sf):
    """Two fields get the names of another schema, the rest is dropped."""
    adapted = adapt.adapt_one_to_one(
        b.doc_values(spark, sf, "title", "source", "language"), {"title": "headline", "source": "origin"}
    )
    return adapted.select("key", "attr", m.payload_text().alias("value"))
