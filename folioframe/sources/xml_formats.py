"""XML formats: MARC, EndNote, PubMed, Web of Knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import doi_from_article_no, expand_page_range, parse_year
from ..functions.names import person_from_comma
from ..model import VALUE, Schema, attributes, one, partial_date, person, qual, quals, to_values, txo, union_all, value
from ..operators.taxonomy import by_name
from .common import Ingest, keyed, malformed, read_xml, tag_counts, violations

_TEXT = "struct<_VALUE:string>"


def _none() -> Column:
    return F.array().cast(f"array<{VALUE}>")


def _list(items: Column, make) -> Column:
    """Values of a possibly missing list, in order, without the missing ones."""
    return F.coalesce(F.array_compact(F.transform(items, lambda x: make(x).cast(VALUE))), _none())


# --- MARC -----------------------------------------------------------------------------------

_MARC = (
    "controlfield array<struct<_tag:string,_VALUE:string>>, "
    "datafield array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_code:string,_VALUE:string>>>>"
)


def _marc_value(kind: str, text: Column) -> Column:
    if kind == "person":
        return value("person", person_from_comma(text, "marc"))
    if kind == "date":
        year = parse_year(text)
        return value("date", F.when(year.isNotNull(), partial_date(year)))
    return value(kind, text)


def ingest_marcxml(spark: SparkSession, path: str, mapping: dict, schema: Schema, row_tag: str = "record") -> Ingest:
    """Reads MARC XML. ``mapping`` maps a control number, or ``(tag, ind1, ind2, code)``, to a
    field of the schema, or to None to skip it. Control fields come before data fields."""
    rows = keyed(read_xml(spark, path, row_tag, _MARC))
    control = F.transform(
        "controlfield",
        lambda c: F.struct(c["_tag"].try_cast("int").cast("string").alias("code"), F.coalesce(c["_VALUE"], F.lit("")).alias("data")),
    )
    data = F.flatten(
        F.transform(
            "datafield",
            lambda d: F.transform(
                d["subfield"],
                lambda s: F.struct(
                    F.concat_ws(
                        "|", d["_tag"].try_cast("int").cast("string"), F.coalesce(d["_ind1"], F.lit("")),
                        F.coalesce(d["_ind2"], F.lit("")), s["_code"],
                    ).alias("code"),
                    F.coalesce(s["_VALUE"], F.lit("")).alias("data"),
                ),
            ),
        )
    )
    empty = F.array().cast("array<struct<code:string,data:string>>")
    rows = rows.withColumn("cells", F.concat(F.coalesce(control, empty), F.coalesce(data, empty)))
    codes = {
        (str(k) if isinstance(k, int) else "|".join([str(k[0]), *k[1:]])): target for k, target in mapping.items()
    }
    fields: dict[str, list[str]] = {}
    for code, target in codes.items():
        if target is not None:
            fields.setdefault(target, []).append(code)

    def of(target: str, those: list[str]) -> Column:
        kind = schema.attrs[target].type
        return _list(F.filter("cells", lambda c: c["code"].isin(those)), lambda c: _marc_value(kind, c["data"]))

    records = rows.select("key", attributes(**{t: of(t, those) for t, those in fields.items()}).alias("attrs"))
    loose = rows.select("key", F.explode("cells").alias("_c")).select("key", "_c.code", "_c.data")
    unknown = loose.filter(F.col("code").contains("|") & ~F.col("code").isin(list(codes)))
    wrong = [malformed(rows), violations(unknown, F.lit(None), "unknown_field", F.col("code"))]
    for target, those in fields.items():
        kind = schema.attrs[target].type
        if kind in ("person", "date"):
            bad = loose.filter(F.col("code").isin(those) & _marc_value(kind, F.col("data")).isNull())
            wrong.append(violations(bad, F.lit(target), "unreadable", F.col("data")))
    skipped = loose.filter(~F.col("code").contains("|") & ~F.col("code").isin(list(codes)))
    return Ingest(to_values(records), union_all(wrong), tag_counts(skipped, "code"))


# --- EndNote --------------------------------------------------------------------------------

_STYLED = "struct<_VALUE:string,style:array<struct<_VALUE:string>>>"


def _styled(cell: Column) -> Column:
    """Text with its styled pieces: the plain part, then the pieces."""
    pieces = F.transform(cell["style"], lambda s: s["_VALUE"])
    return F.concat(F.coalesce(cell["_VALUE"], F.lit("")), F.coalesce(F.array_join(pieces, ""), F.lit("")))


def ingest_endnote_xml(
    spark: SparkSession, path: str, mapping: dict[str, str], schema: Schema, row_tag: str = "RECORD",
    items: DataFrame | None = None,
) -> Ingest:
    """Reads EndNote XML. ``mapping`` maps an element, or ``LIST/ELEMENT``, to a field."""
    parts: dict[str, list[str]] = {}
    for source in mapping:
        head, _, tail = source.partition("/")
        parts.setdefault(head, []).append(tail)
    columns = [
        f"`{head}` struct<{', '.join(f'`{t}`:array<{_STYLED}>' for t in tails)}>" if any(tails) else f"`{head}` {_STYLED}"
        for head, tails in parts.items()
    ]
    rows = keyed(read_xml(spark, path, row_tag, ", ".join(columns)))
    fields: dict[str, Column] = {}
    coded = None
    for source, target in mapping.items():
        head, _, tail = source.partition("/")
        kind = schema.attrs[target].type
        if kind == "txo":
            coded = (target, _styled(F.col(head)))
            continue
        if kind == "person":
            make = lambda c: value("person", person_from_comma(_styled(c), "endnote"))
        else:
            make = lambda c, kind=kind: value(kind, _styled(c))
        cells = F.col(head)[tail] if tail else F.when(F.col(head).isNotNull(), F.array(head))
        fields[target] = F.concat(fields.get(target, _none()), _list(cells, make))
    wrong = malformed(rows)
    if coded is not None and items is not None:
        target, name = coded
        grp = schema.attrs[target].grp
        named = by_name(rows.withColumn("_type", name), items, grp, "_type")
        rows = named.withColumnRenamed("id", "_code")
        fields[target] = one(value("txo", F.when(F.col("_code").isNotNull(), txo(grp, F.col("_code")))))
        unknown = rows.filter(F.col("_code").isNull() & (F.col("_type") != ""))
        wrong = wrong.unionByName(violations(unknown, F.lit(target), "unknown_item", F.col("_type")))
    records = rows.select("key", attributes(**fields).alias("attrs"))
    none = spark.createDataFrame([], "tag string, n bigint")
    return Ingest(to_values(records), wrong, none)


# --- PubMed ---------------------------------------------------------------------------------

_PUBMED = f"""
PMID {_TEXT},
MedlineJournalInfo struct<MedlineTA:string>,
Article struct<
  ArticleTitle:string,
  Abstract:struct<AbstractText:array<string>>,
  Journal:struct<Title:string, ISSN:{_TEXT},
    JournalIssue:struct<Volume:string, Issue:string, PubDate:struct<Year:string, Month:string>>>,
  Pagination:struct<MedlinePgn:string>,
  AuthorList:struct<Author:array<struct<LastName:string, ForeName:string, FirstName:string>>>>
"""


def _plain(text: Column) -> Column:
    """Text without the inline markup that PubMed allows; with markup inside it comes escaped."""
    marked = text.rlike(r"</(?:b|i|sup|sub|u)>")
    return F.when(marked, _unescape(F.regexp_replace(text, r"</?(?:b|i|sup|sub|u)\b[^>]*>", ""))).otherwise(text)


def ingest_pubmed_xml(spark: SparkSession, path: str) -> Ingest:
    """Reads PubMed citations. A journal without a title takes the short one."""
    rows = keyed(read_xml(spark, path, "MedlineCitation", " ".join(_PUBMED.split())))
    article, journal = F.col("Article"), F.col("Article.Journal")
    issue = journal["JournalIssue"]
    pages = F.col("Article.Pagination.MedlinePgn")
    about = quals(
        qual("issn", "id", journal["ISSN"]["_VALUE"]),
        qual("volume", "text", issue["Volume"]),
        qual("issue", "text", issue["Issue"]),
        qual("year", "text", issue["PubDate"]["Year"]),
        qual("month", "text", issue["PubDate"]["Month"]),
        qual("pages", "text", F.when(pages != "", expand_page_range(pages))),
    )
    short = F.when(F.size(about) > 0, F.col("MedlineJournalInfo.MedlineTA"))
    title = F.coalesce(journal["Title"], short)
    authors = _list(
        article["AuthorList"]["Author"],
        lambda a: value("person", person(a["LastName"], F.coalesce(F.nullif(a["ForeName"], F.lit("")), a["FirstName"]))),
    )
    records = rows.select(
        "key",
        attributes(
            pmid=one(value("id", F.col("PMID._VALUE"))),
            title=one(value("text", _plain(article["ArticleTitle"]))),
            # An abstract in sections has several texts; the first is the abstract.
            abstract=one(value("text", _plain(F.try_element_at(article["Abstract"]["AbstractText"], F.lit(1))))),
            journal=one(value("text", title, about)),
            author=authors,
        ).alias("attrs"),
    )
    untitled = rows.filter(title.isNull() & (F.size(about) > 0))
    wrong = malformed(rows).unionByName(violations(untitled, F.lit("journal"), "incomplete", F.lit("journal")))
    return Ingest(to_values(records), wrong, spark.createDataFrame([], "tag string, n bigint"))


# --- Web of Knowledge -----------------------------------------------------------------------

def _wok_authors() -> Column:
    """Authors in the order of the elements.

    Each author is a short name, and may be followed by the full one, which then replaces it.
    The XML source groups elements by name, so the original order is read from the element
    text, where the children of ``authors`` still stand one after the other.
    """
    tags = r"<(primaryauthor|author|fullauthorname)\b[^>]*>([\s\S]*?)</\1>"
    kinds = F.regexp_extract_all("authors", F.lit(tags), F.lit(1))
    bodies = F.regexp_extract_all("authors", F.lit(tags), F.lit(2))
    inner = lambda body, tag: F.nullif(F.regexp_extract(body, f"<{tag}[^>]*>([\\s\\S]*?)</{tag}>", 1), F.lit(""))

    def author(kind: Column, n: Column) -> Column:
        body = F.try_element_at(bodies, n + 1)
        replaced = F.try_element_at(kinds, n + 2) == "fullauthorname"
        full = person(_unescape(inner(body, "AuLastName")), _unescape(inner(body, "AuFirstName")))
        short = person_from_comma(_unescape(body), "wok")
        return F.when(kind == "fullauthorname", value("person", full)).when(
            ~F.coalesce(replaced, F.lit(False)), value("person", short)
        )

    return F.array_compact(F.transform(kinds, author))


def _unescape(text: Column) -> Column:
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def ingest_wok_xml(spark: SparkSession, path: str, items: DataFrame, row_tag: str = "item") -> Ingest:
    """Reads Web of Knowledge items."""
    schema = """
    ut string, authors string, corp_authors struct<corp_author:array<string>>, refs struct<ref:array<string>>,
    keywords struct<keyword:array<string>>, keywords_plus struct<keyword:array<string>>,
    abstract struct<_avail:string, p:array<string>>, doctype struct<_code:string>,
    source_title string, item_title string, source_series string, source_abbrev string,
    article_nos struct<article_no:array<string>>, bib_pages struct<_VALUE:string>,
    bib_issue struct<_vol:string, _year:string>"""
    rows = keyed(read_xml(spark, path, row_tag, " ".join(schema.split())))
    rows = by_name(rows.withColumn("_code", F.col("doctype._code")), items, "doctype", "_code").withColumnRenamed("id", "_type")
    companies = _list(F.col("corp_authors.corp_author"), lambda a: value("person", person(a)))
    texts = lambda c: _list(F.col(c), lambda t: value("text", t))
    paragraphs = F.array_join(F.col("abstract.p"), "\n")
    filled = lambda c: F.nullif(c, F.lit(""))
    about = quals(
        qual("series", "text", F.col("source_series")),
        qual("abbrev", "text", F.col("source_abbrev")),
        qual("pages", "text", F.col("bib_pages._VALUE")),
        qual("volume", "text", filled(F.col("bib_issue._vol"))),
        qual("year", "text", filled(F.col("bib_issue._year"))),
    )
    records = rows.select(
        "key",
        attributes(
            **{
                "ut": one(value("id", F.col("ut"))),
                "author": F.concat(F.coalesce(_wok_authors(), _none()), companies),
                "ref": _list(F.col("refs.ref"), lambda t: value("id", t)),
                "keyword": texts("keywords.keyword"),
                "keyword-plus": texts("keywords_plus.keyword"),
                "abstract": one(value("text", F.when(F.lower(F.col("abstract._avail")) == "y", paragraphs))),
                "doctype": one(value("txo", F.when(F.col("_type").isNotNull(), txo("doctype", F.col("_type"))))),
                "source": one(value("text", F.col("source_title"), about)),
                "title": one(value("text", F.col("item_title"))),
                "doi": _list(F.col("article_nos.article_no"), lambda t: value("id", doi_from_article_no(t))),
            }
        ).alias("attrs"),
    )
    numbers = rows.select("key", F.explode("article_nos.article_no").alias("_no"))
    other = numbers.filter(doi_from_article_no(F.col("_no")).isNull())
    unknown = rows.filter(F.col("_code").isNotNull() & F.col("_type").isNull())
    orphans = rows.filter(F.col("source_title").isNull() & (F.size(about) > 0))
    wrong = union_all(
        [
            malformed(rows),
            violations(unknown, F.lit("doctype"), "unknown_item", F.col("_code")),
            violations(orphans, F.lit("source"), "incomplete", F.lit("source")),
        ]
    )
    return Ingest(to_values(records), wrong, tag_counts(other.withColumn("tag", F.lit("article_no")), "tag"))
