"""Schemas of the record databases the readers fill. Fixed values throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import Attribute, Qualifier, Schema

# Text fields of BibTeX entries, in schema order.
_BIBTEX_TEXT = (
    "crossref key address_1 address_2 title specifictitle journal special type booktitle subject "
    "ownership series edition volume number chapter pages school organization location dates "
    "institution publisher address format noseries confplace cote ieeecn locn isbn issn note "
    "language howpublished to_appear from received owner keywords abstract remarks"
).split()

BIBTEX_DOCTYPES = (
    "article", "book", "booklet", "inbook", "incollection", "inproceedings", "manual",
    "mastersthesis", "misc", "phdthesis", "proceedings", "techreport", "unpublished",
)

BIBTEX = Schema(
    "bibtex",
    {
        "id": Attribute("id"),
        "doctype": Attribute("txo", grp="doctype"),
        "author": Attribute("person"),
        "editor": Attribute("person"),
        "date": Attribute("date"),
        "url": Attribute("url"),
        **{name: Attribute("text") for name in _BIBTEX_TEXT},
    },
)

PUBMED = Schema(
    "pubmed",
    {
        "pmid": Attribute("id"),
        "journal": Attribute(
            "text",
            quals={
                "issn": Qualifier("id"), "volume": Qualifier("text"), "issue": Qualifier("text"),
                "year": Qualifier("text"), "month": Qualifier("text"), "pages": Qualifier("text"),
            },
        ),
        "title": Attribute("text"),
        "abstract": Attribute("text"),
        "author": Attribute("person"),
    },
)

# Document types by code; the position is the id.
WOK_DOCTYPES = (
    ("2", "Abstract of Published Item"), ("A", "Art Exhibit Review"), ("@", "Article"),
    ("7", "Bibliography"), ("I", "Biographical Item"), ("B", "Book review"), ("K", "Chronology"),
    ("C", "Correction"), ("Z", "Dance Performance Review"), ("0", "Database Review"),
    ("D", "Discussion"), ("E", "Editorial Material"), ("X", "Excerpt"),
    ("O", "Fiction, Creative Prose"), ("F", "Film Review"), ("8", "Hardware Review"),
    ("L", "Letter"), ("M", "Meeting Abstract"), ("J", "Music Performance Review"),
    ("S", "Music Score"), ("G", "Music Score Review"), ("5", "News item"), ("N", "Note"),
    ("Y", "Poetry"), ("H", "Record Review"), ("6", "Reprint"), ("R", "Review"), ("Q", "Script"),
    ("9", "Software Review"), ("V", "TV Review, Radio Review"), ("T", "Theater Review"),
)

WOK = Schema(
    "wok",
    {
        "ut": Attribute("id"),
        "doi": Attribute("id"),
        "author": Attribute("person"),
        "ref": Attribute("id"),
        "abstract": Attribute("text"),
        "keyword": Attribute("text"),
        "keyword-plus": Attribute("text"),
        "doctype": Attribute("txo", grp="doctype"),
        "source": Attribute(
            "text",
            quals={
                "abbrev": Qualifier("text"), "series": Qualifier("text"), "pages": Qualifier("text"),
                "volume": Qualifier("text"), "number": Qualifier("text"), "year": Qualifier("text"),
                "issn": Qualifier("id"),
            },
        ),
        "title": Attribute("text"),
        "article_no": Attribute("text"),
    },
)

CROSSREF = Schema(
    "crossref",
    {
        "doctype": Attribute("txo", grp="doctype"),
        "doi": Attribute("id"), "issn": Attribute("id"),
        "title": Attribute("text"), "serial": Attribute("text"), "edition": Attribute("text"),
        "author": Attribute("person"),
        "volume": Attribute("text"), "issue": Attribute("text"), "startpage": Attribute("text"),
        "part": Attribute("text"),
        "year": Attribute("date"),
    },
)

RIS = Schema(
    "ris",
    {
        **{
            n: Attribute("text")
            for n in "title note journal volume issue city publisher abstract issn availability address".split()
        },
        "id": Attribute("id"),
        "url": Attribute("url"),
        "author": Attribute("person"),
        "date": Attribute("date"),
    },
)

ITEMS = "grp string, id int, parent int, names map<string,string>"


def bibtex_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("doctype", i, None, {"C": n}) for i, n in enumerate(BIBTEX_DOCTYPES, 1)], ITEMS
    )


def wok_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("doctype", i, None, {"C": code, "": name}) for i, (code, name) in enumerate(WOK_DOCTYPES, 1)], ITEMS
    )
