"""Cleaning jobs: raw strings of a whole table to typed values, with the rule that fired.

Every job returns the cleaned rows with a ``rule`` column, where the rule ``error`` marks
input that no rule accepts; ``report`` counts rules and ``rejected`` gives the violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as c
from ..functions import names as n
from ..functions.latex import latex_decode, latex_encode
from ..functions.terms import url_words
from ..model import partial_date


def clean_persons(raw: DataFrame, column: str = "raw", fmt: str = "bibtex") -> DataFrame:
    """One row per name: the input columns, ``pos``, ``name``, ``person`` and ``rule``."""
    if fmt != "bibtex":
        people = raw.withColumn("person", n.person_from_comma(F.col(column), fmt))
        return people.select(
            *raw.columns, F.lit(0).alias("pos"), F.col(column).alias("name"), "person",
            F.when(F.col("person").isNull(), "error").otherwise(fmt).alias("rule"),
        )
    rows = raw.select("*", F.posexplode(n.split_names(F.col(column))).alias("pos", "name"))
    rows = rows.withColumn("_read", n.read_person(F.col("name")))
    return rows.select(*raw.columns, "pos", "name", F.col("_read.person").alias("person"), F.col("_read.rule").alias("rule"))


def clean_dates(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``date`` and ``rule``: ``Y/M/D`` first, then a year anywhere in the text."""
    ris = c.parse_ris_date(F.col(column))
    year = c.parse_year(F.col(column))
    rule = (
        F.when(ris["year"].isNotNull(), "ris").when(year.isNotNull(), "year").otherwise("error")
    )
    date = F.when(rule == "ris", ris).when(rule == "year", partial_date(year))
    return raw.withColumn("rule", rule).withColumn("date", date)


def clean_pages(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``pages`` and ``rule`` (expanded, range, single)."""
    full = c.expand_page_range(F.col(column))
    rule = (
        F.when(F.col(column).isNull(), "error")
        .when(full != F.col(column), "expanded")
        .when(full.contains("-"), "range")
        .otherwise("single")
    )
    return raw.withColumn("rule", rule).withColumn("pages", full)


def clean_identifiers(raw: DataFrame, column: str = "raw", source: str = "ISI") -> DataFrame:
    """Adds ``id``, ``terms`` and ``rule``: a source prefix, a DOI note, or a url."""
    text = F.col(column)
    ident, doi = c.strip_source_prefix(text, source), c.doi_from_article_no(text)
    is_url = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    rule = (
        F.when(ident.isNotNull(), "source_prefix")
        .when(doi.isNotNull(), "doi")
        .when(is_url, "url")
        .otherwise("error")
    )
    return (
        raw.withColumn("rule", rule)
        .withColumn("id", F.coalesce(ident, doi, F.when(is_url, text)))
        .withColumn("terms", F.when(is_url, url_words(text)))
    )


def clean_text(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``clean`` (decoded, whitespace collapsed), ``coded`` (the way back) and ``rule``."""
    text = F.col(column)
    out = raw.withColumn("clean", c.collapse_whitespace(latex_decode(text)))
    rule = (
        F.when(text.isNull(), "error")
        .when(text.rlike(r"[\\{}]"), "decoded")
        .when(F.col("clean") != text, "collapsed")
        .otherwise("unchanged")
    )
    return out.withColumn("rule", rule).withColumn("coded", latex_encode(F.col("clean")))


def format_names(rows: DataFrame, column: str = "authors") -> DataFrame:
    """Adds the display forms of a list of persons."""
    people = F.col(column)
    return (
        rows.withColumn("last_first", F.transform(people, n.last_first))
        .withColumn("first_last", F.transform(people, n.first_last))
        .withColumn("initial_last", F.transform(people, n.initial_last))
    )


def report(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def rejected(cleaned: DataFrame, attr: str, column: str = "raw", pos: Column | None = None) -> DataFrame:
    position = F.lit(0) if pos is None else pos
    return cleaned.filter(F.col("rule") == "error").select(
        "key", F.lit(attr).alias("attr"), position.cast("int").alias("pos"),
        F.lit("unreadable").alias("rule"), F.col(column).alias("detail"),
    )
