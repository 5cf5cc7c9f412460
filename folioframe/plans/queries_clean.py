"""Cleaning jobs and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions import clean as c
from ..functions import latex, names, style
from ..operators import cite
from ..operators import clean as jobs
from . import bindings as b
from .registry import query

# --- persons --------------------------------------------------------------------------------

_PART_NAMES = """
n AS (SELECT p_partkey + 1 AS key, p_name, p_brand, p_size,
             split_part(p_name, ' ', 1) AS f0, split_part(p_name, ' ', 2) AS l0,
             upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) AS f,
             upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS l FROM part)"""


def _raw_names(spark, sf):
    """Every way to write a name, a company in braces, and for some a name nobody can read."""
    part = b.table(spark, sf, "part")
    first = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))
    last = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    initial = F.concat(F.left(first, F.lit(1)), F.lit("."))
    form = F.col("p_size") % 6
    name = (
        F.when(form == 0, F.col("p_name"))
        .when(form == 1, F.concat_ws(" ", first, last))
        .when(form == 2, F.concat(last, F.lit(", "), first))
        .when(form == 3, F.concat_ws(" ", initial, last))
        .when(form == 4, F.concat_ws(" ", last, initial))
        .otherwise(F.concat(initial, F.lit(" -J. van~"), last))
    )
    company = F.concat(F.lit(" and {"), F.col("p_brand"), F.lit(" and Co}"))
    odd = F.when(F.col("p_type") == "LARGE", F.lit(" and Aa Bb Cc Dd")).otherwise("")
    return part.select((F.col("p_partkey") + 1).alias("key"), F.concat(name, company, odd).alias("raw"))


_PERSONS = f"""WITH {_PART_NAMES},
forms AS (SELECT *, p_size % 6 AS form, left(f, 1) || '.' AS i FROM n)
SELECT key, 0 AS pos,
       CASE form WHEN 0 THEN '' WHEN 1 THEN f WHEN 2 THEN f WHEN 3 THEN i WHEN 4 THEN i ELSE i || '-J.' END AS first,
       CASE form WHEN 0 THEN p_name WHEN 5 THEN 'van ' || l ELSE l END AS last,
       CASE form WHEN 0 THEN 'particle' WHEN 1 THEN 'first_last' WHEN 2 THEN 'comma' WHEN 3 THEN 'initials_last'
                 WHEN 4 THEN 'last_initials' ELSE 'particle' END AS rule FROM forms
UNION ALL SELECT key, 1, NULL, p_brand || ' and Co', 'braced' FROM forms
UNION ALL SELECT p_partkey + 1, 2, NULL, NULL, 'error' FROM part WHERE p_type = 'LARGE'"""


@query(_PERSONS)
def clean_persons(spark, sf):
    rows = jobs.clean_persons(_raw_names(spark, sf))
    return rows.select("key", "pos", "person.first", "person.last", "rule")


@query(_PERSONS)
def person_from_bibtex(spark, sf):
    """The expressions of the job by themselves, over names already split."""
    split = _raw_names(spark, sf).select("key", F.posexplode(names.split_names(F.col("raw"))).alias("pos", "name"))
    read = split.withColumn("r", names.read_person(F.col("name")))
    return read.select("key", "pos", F.col("r.person.first").alias("first"), F.col("r.person.last").alias("last"), "r.rule")


@query(f"SELECT rule, count(*) AS n FROM ({_PERSONS}) GROUP BY rule")
def clean_report(spark, sf):
    return jobs.report(jobs.clean_persons(_raw_names(spark, sf)))


@query("SELECT p_partkey + 1 AS key, 'author' AS attr, 2 AS pos, 'unreadable' AS rule, 'Aa Bb Cc Dd' AS detail FROM part WHERE p_type = 'LARGE'")
def clean_rejected(spark, sf):
    return jobs.rejected(jobs.clean_persons(_raw_names(spark, sf)), "author", "name", F.col("pos"))


@query(f"""WITH {_PART_NAMES},
raw AS (SELECT key, f, l, p_size % 4 AS form FROM n), fmt AS (SELECT unnest(['ris', 'isi', 'marc', 'endnote', 'wok']) AS fmt)
SELECT key, fmt,
  CASE WHEN form = 0 THEN NULL WHEN form < 2 OR fmt = 'ris' THEN f END AS first,
  CASE WHEN form = 0 OR form = 1 OR fmt = 'ris' THEN l
       WHEN fmt = 'marc' THEN NULL
       WHEN form = 2 THEN l || ', ' || f || ', Jr' ELSE l || ', ' || f || ', Jr, x' END AS last,
  CASE WHEN form >= 2 AND fmt = 'ris' THEN 'Jr' END AS lineage
FROM raw, fmt""")
def person_from_comma(spark, sf):
    """The same raw names read in the convention of each format."""
    part = b.table(spark, sf, "part")
    first = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))
    last = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    form = F.col("p_size") % 4
    raw = (
        F.when(form == 0, last)
        .when(form == 1, F.concat_ws(", ", last, first))
        .when(form == 2, F.concat_ws(", ", last, first, F.lit("Jr")))
        .otherwise(F.concat_ws(", ", last, first, F.lit("Jr"), F.lit("x")))
    )
    rows = part.select((F.col("p_partkey") + 1).alias("key"), raw.alias("raw"))
    return m.union_all(
        [
            rows.select("key", F.lit(fmt).alias("fmt"), names.person_from_comma(F.col("raw"), fmt).alias("p"))
            .select("key", "fmt", "p.first", "p.last", "p.lineage")
            for fmt in names.COMMA_FORMATS
        ]
    )


# --- dates, pages, identifiers --------------------------------------------------------------


@query("""
SELECT o_orderkey + 1 AS key,
  CAST(CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS INTEGER) AS year,
  CAST(CASE WHEN o_orderstatus = 'F' THEN month(o_orderdate) END AS INTEGER) AS month,
  CAST(CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN day(o_orderdate) END AS INTEGER) AS day,
  CASE o_orderstatus WHEN 'F' THEN 'ris' WHEN 'O' THEN 'year' ELSE 'error' END AS rule
FROM orders""")
def clean_dates(spark, sf):
    """Dates of orders as Y/M/D with or without a day, as a note, and not at all."""
    date = F.col("o_orderdate")
    raw = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.when(F.col("o_custkey") % 2 == 0, F.date_format(date, "yyyy/MM/dd")).otherwise(F.date_format(date, "yyyy/MM//")),
        )
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Zurich : c"), F.year(date).cast("string"), F.lit(", in print")))
        .otherwise(F.lit("[n.d.]"))
    )
    rows = b.table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("key"), raw.alias("raw"))
    return jobs.clean_dates(rows).select("key", "date.year", "date.month", "date.day", "rule")


@query("""SELECT o_orderkey + 1 AS key, CAST(month(o_orderdate) AS INTEGER) AS month,
                 CAST(year(o_orderdate) AS VARCHAR) AS year_text FROM orders""")
def month_number(spark, sf):
    """Month names, long or short by the status of the order."""
    date = F.col("o_orderdate")
    raw = F.when(F.col("o_orderstatus") == "F", F.date_format(date, "MMMM")).otherwise(F.concat(F.lit(" "), F.upper(F.date_format(date, "MMM"))))
    return b.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("key"), c.month_number(raw).alias("month"),
        c.format_year(m.partial_date(F.year(date))).alias("year_text"),
    )


_PAGES = """
p AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(10684 + o_orderkey AS VARCHAR) AS a,
             CAST(10684 + o_orderkey + o_custkey % 50 AS VARCHAR) AS z FROM orders)"""


@query(f"""WITH {_PAGES}
SELECT k + 1 AS key,
  CASE s WHEN 'F' THEN a WHEN 'O' THEN a || '-' || z
         ELSE CASE WHEN left(a, length(a) - 2) || right(z, 2) > a THEN left(a, length(a) - 2) || right(z, 2) END END AS full_range,
  CASE WHEN s = 'P' AND left(a, length(a) - 2) || right(z, 2) > a THEN 'expanded' WHEN s = 'F' THEN 'single' ELSE 'range' END AS rule,
  CASE WHEN a = z THEN a ELSE a || '-' || z END AS both,
  CASE s WHEN 'F' THEN 'page' ELSE 'pages' END AS label
FROM p""")
def clean_pages(spark, sf):
    """Single pages, full ranges, and ranges that give only the last two digits of the end."""
    start = (F.col("o_orderkey") + 10684).cast("string")
    end = (F.col("o_orderkey") + 10684 + F.col("o_custkey") % 50).cast("string")
    raw = (
        F.when(F.col("o_orderstatus") == "F", start)
        .when(F.col("o_orderstatus") == "O", F.concat_ws("-", start, end))
        .otherwise(F.concat_ws("-", start, F.right(end, F.lit(2))))
    )
    rows = b.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("key"), F.col("o_orderstatus").alias("s"), raw.alias("raw"),
        c.page_range(start, end).alias("both"),
    )
    done = jobs.clean_pages(rows)
    right_side = F.substring_index("pages", "-", -1)
    shown = F.when(F.col("s") != "P", F.col("pages")).when(F.col("rule") == "expanded", right_side)
    label = F.split_part(c.pages_label(F.col("pages")), F.lit(" "), F.lit(1))
    return done.select("key", shown.alias("full_range"), "rule", "both", label.alias("label"))


@query("""SELECT url AS raw, url AS id, 'url' AS rule FROM pages
          UNION ALL SELECT 'ISI:A' || p_partkey, 'A' || p_partkey, 'source_prefix' FROM part WHERE p_size <= 20
          UNION ALL SELECT ' DOI 10.1/' || p_partkey, '10.1/' || p_partkey, 'doi' FROM part WHERE p_size > 20 AND p_size <= 40
          UNION ALL SELECT 'INSPEC:' || p_partkey, NULL, 'error' FROM part WHERE p_size > 40""")
def clean_identifiers(spark, sf):
    number = F.col("p_partkey").cast("string")
    raw = (
        F.when(F.col("p_size") <= 20, F.concat(F.lit("ISI:A"), number))
        .when(F.col("p_size") <= 40, F.concat(F.lit(" DOI 10.1/"), number))
        .otherwise(F.concat(F.lit("INSPEC:"), number))
    )
    rows = b.table(spark, sf, "pages").select(F.col("url").alias("raw")).union(b.table(spark, sf, "part").select(raw))
    return jobs.clean_identifiers(rows).select("raw", "id", "rule")


@query("""SELECT p_partkey + 1 AS key, p_name || '|' || p_brand || '|' || p_type AS keywords FROM part""")
def split_keywords(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit("; "), F.col("p_brand"), F.lit(" ;"), F.col("p_type"))
    return b.table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("key"), F.array_join(c.split_keywords(raw), "|").alias("keywords")
    )


# --- text -----------------------------------------------------------------------------------

_BLANKS = r"[ \t\n\x0B\f\r]+"


def _sql_latex() -> str:
    """The coded form of each character of a text, written out for the letters of the languages."""
    # Characters and their LaTeX code.
    coded = {
        "À": "\\`A", "È": "\\`E", "à": "\\`a", "è": "\\`e", "ù": "\\`u",
        "Á": "\\'A", "É": "\\'E", "Í": "\\'I", "Ó": "\\'O", "Ú": "\\'U",
        "á": "\\'a", "é": "\\'e", "í": "\\'{\\i}", "ó": "\\'o", "ú": "\\'u",
        "Â": "\\^A", "Ê": "\\^E", "â": "\\^a", "ê": "\\^e", "î": "\\^{\\i}", "ô": "\\^o", "û": "\\^u",
        "Ñ": "\\~N", "ñ": "\\~n", "Ä": '\\"A', "Ë": '\\"E', "Ö": '\\"O', "Ü": '\\"U',
        "ä": '\\"a', "ë": '\\"e', "ï": '\\"{\\i}', "ö": '\\"o', "ü": '\\"u',
        "Ç": "\\c{C}", "ç": "\\c{c}", "ß": "\\ss{}",
    }
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    keys = ", ".join(quote(k) for k in coded)
    values = ", ".join(quote(v) for v in coded.values())
    return f"""array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda ch: CASE
        WHEN ord(ch) BETWEEN 32 AND 127 AND NOT contains('{{}}%\\$', ch) THEN ch
        ELSE coalesce((map([{keys}], [{values}]))[ch], '\\char' || ord(ch) || '{{}}') END), '')"""


@query(f"SELECT doc_id + 1 AS key, {_sql_latex()} AS coded FROM documents")
def latex_encode(spark, sf):
    return b.documents(spark, sf).select(b.doc_key().alias("key"), latex.latex_encode(F.col("text")).alias("coded"))


@query("SELECT doc_id + 1 AS key, text FROM documents")
def latex_decode(spark, sf):
    """Encoding and decoding whole texts gives them back."""
    coded = latex.latex_encode(F.col("text"))
    return b.documents(spark, sf).select(b.doc_key().alias("key"), latex.latex_decode(coded).alias("text"))


@query(f"SELECT doc_id + 1 AS key, regexp_replace(text, '{_BLANKS}', ' ', 'g') AS clean FROM documents")
def clean_text(spark, sf):
    """Coded texts become plain ones with single blanks."""
    coded = b.documents(spark, sf).select(b.doc_key().alias("key"), latex.latex_encode(F.col("text")).alias("raw"))
    return jobs.clean_text(coded).select("key", "clean")


# --- names and styles -----------------------------------------------------------------------

# Reference rows as SQL: authors as a list of {f, l, i} with i the initials of f.
SQL_REFS = """
a AS (SELECT *, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) AS f,
             upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS l,
             'B' || substr(p_brand, 7) AS br, left(p_type, 1) || lower(substr(p_type, 2)) AS ty FROM part),
refs AS (SELECT p_partkey + 1 AS uid, p_partkey, p_size, p_size % 4 AS n,
  list_slice([{'f': f, 'l': l, 'i': left(f, 1) || '.'}, {'f': br, 'l': ty, 'i': regexp_replace(br, '(.)', '\\1.', 'g')},
              {'f': ty, 'l': br, 'i': left(ty, 1) || '.'}], 1, p_size % 4) AS authors,
  p_brand || ' & ' || p_name AS title, p_brand || ' &amp; ' || p_name AS title_html,
  CASE WHEN p_type = 'ECONOMY' THEN 'Journal of ' || f || ' ' || l END AS journal,
  CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size AS VARCHAR) END AS volume,
  CASE WHEN p_type = 'ECONOMY' AND p_size > 25 THEN CAST(p_size - 25 AS VARCHAR) END AS number,
  CASE WHEN p_type = 'ECONOMY' THEN p_partkey || '-' || (p_partkey + p_size) END AS pages,
  CASE WHEN p_size <> 7 AND p_size % 8 <> 4 THEN CAST(2000 + p_size % 2 AS VARCHAR) END AS year,
  CASE p_type WHEN 'ECONOMY' THEN 'article' WHEN 'SMALL' THEN 'book' WHEN 'PROMO' THEN 'manual' WHEN 'LARGE' THEN 'misc'
              WHEN 'MEDIUM' THEN 'techreport' ELSE 'unpublished' END AS doctype FROM a),
parts AS (SELECT *,
  CASE n WHEN 0 THEN NULL WHEN 1 THEN authors[1].f || ' ' || authors[1].l
    WHEN 2 THEN authors[1].f || ' ' || authors[1].l || ' and ' || authors[2].f || ' ' || authors[2].l
    ELSE authors[1].f || ' ' || authors[1].l || ', ' || authors[2].f || ' ' || authors[2].l || ', and ' || authors[3].f || ' ' || authors[3].l END AS who,
  volume || coalesce(':' || number, '') || '(' || pages || ')' AS issue,
  CASE WHEN doctype = 'article' THEN NULL ELSE year END AS plain_year FROM refs),
styled AS (SELECT *,
  CASE WHEN doctype = 'article' THEN concat_ws(', ', '<i>' || journal || '</i>', issue, year) ELSE year END AS place_html,
  CASE WHEN doctype = 'article' THEN concat_ws(', ', journal, issue, year) ELSE year END AS place FROM parts)"""


def reference_rows(spark, sf):
    return cite.reference_rows(b.part_records(spark, sf), b.doctype_items(spark))


@query(f"""WITH {SQL_REFS} SELECT uid,
  array_to_string(list_transform(authors, lambda x: x.l || ', ' || x.f), '; ') AS last_first,
  array_to_string(list_transform(authors, lambda x: x.f || ' ' || x.l), '; ') AS first_last,
  array_to_string(list_transform(authors, lambda x: x.i || ' ' || x.l), '; ') AS initial_last
FROM refs WHERE n > 0""")
def format_names(spark, sf):
    rows = jobs.format_names(reference_rows(spark, sf).filter(F.col("authors").isNotNull()))
    shown = ("last_first", "first_last", "initial_last")
    return rows.select("uid", *[F.array_join(n, "; ").alias(n) for n in shown])


@query(f"""WITH {_PART_NAMES}
SELECT key, left(f, 1) || '.' || left(l, 1) || '.' AS spaced, left(f, 1) || '.-' || left(l, 1) || '.' AS dashed,
       left(f, 1) || '.' || left(l, 1) || '.' AS packed FROM n""")
def initials(spark, sf):
    """Two first names with a blank, with a dash, and as capitals that are initials already."""
    part = b.table(spark, sf, "part")
    one = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))
    two = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return part.select(
        (F.col("p_partkey") + 1).alias("key"),
        names.initials(F.concat_ws(" ", one, two)).alias("spaced"),
        names.initials(F.concat_ws("-", one, two)).alias("dashed"),
        names.initials(F.concat(F.left(one, F.lit(1)), F.left(two, F.lit(1)))).alias("packed"),
    )


@query(f"""WITH {SQL_REFS} SELECT uid, title || journal AS sum, coalesce(journal, title) AS either,
  CASE WHEN volume IS NULL THEN NULL WHEN number IS NULL THEN volume || ' / ' || pages
       ELSE volume || ':' || number || ' / ' || pages END AS joined,
  CASE doctype WHEN 'article' THEN journal WHEN 'book' THEN 'Book ' || title ELSE title END AS switched,
  CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'editor' ELSE 'editors' END AS counted,
  CASE WHEN journal IS NULL THEN title ELSE journal END AS told
FROM refs""")
def format_combinators(spark, sf):
    """Sum, or, join with two separators, switch, plural and text by language."""
    col = F.col
    told = F.map_filter(F.create_map(F.lit("en"), col("journal"), F.lit(""), col("title")), lambda _, v: v.isNotNull())
    return reference_rows(spark, sf).select(
        "uid",
        style.both(col("title"), col("journal")).alias("sum"),
        style.either(col("journal"), col("title")).alias("either"),
        style.join(col("volume"), col("number"), col("pages"), mid=":", last=" / ").alias("joined"),
        style.switch(
            col("doctype"), {"article": col("journal"), "book": style.both(F.lit("Book "), col("title"))}, col("title")
        ).alias("switched"),
        style.plural(col("authors"), F.lit("editors"), one=F.lit("editor")).alias("counted"),
        style.i18n(told, "en").alias("told"),
    )


@query(f"""WITH {SQL_REFS} SELECT uid,
  '<b>' || title_html || '</b><br><small>' || coalesce('<i>' || journal || '</i>', '<span class="none">-</span>') || '</small>' AS html,
  title || chr(10) || coalesce(journal, '-') AS text,
  '<a href="http://host/?q=' || p_partkey || '&amp;x">' || title_html || '</a>' AS link_html,
  title || ' <http://host/?q=' || p_partkey || '&x>' AS link_text
FROM refs""")
def format_tags(spark, sf):
    """The same marks in both outputs."""

    def shown(out):
        journal = style.either(out.i(out.text(F.col("journal"))), out.span(F.lit("-"), _class="none"))
        return style.both(out.b(out.text(F.col("title"))), out.br(), out.small(journal))

    href = F.concat(F.lit("http://host/?q="), (F.col("uid") - 1).cast("string"), F.lit("&x"))
    link = lambda out: out.a(out.text(F.col("title")), href)
    return reference_rows(spark, sf).select(
        "uid", shown(style.html).alias("html"), shown(style.text).alias("text"),
        link(style.html).alias("link_html"), link(style.text).alias("link_text"),
    )


@query(f"WITH {SQL_REFS} SELECT uid, who FROM parts")
def style_chicago(spark, sf):
    return reference_rows(spark, sf).select("uid", style.author_part(style.text).alias("who"))


@query(f"""WITH {SQL_REFS} SELECT uid, concat_ws('. ', who, title_html, place_html) || '.' AS html,
           concat_ws('. ', who, title, place) || '.' AS text FROM styled""")
def style_plain(spark, sf):
    return reference_rows(spark, sf).select("uid", style.plain(style.html).alias("html"), style.plain(style.text).alias("text"))


@query(f"""WITH {SQL_REFS} SELECT uid, concat_ws(chr(10), '<span size="large" weight="bold">' || title_html || '</span>',
             '<span size="large">' || who || '</span>', '<span size="large">' || place_html || '</span>') AS html FROM styled""")
def style_full(spark, sf):
    return reference_rows(spark, sf).select("uid", style.full(style.html).alias("html"))
