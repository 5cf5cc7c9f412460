"""Dates, pages, identifiers, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import partial_date

# Month names in English, full and short.
MONTHS = {
    "january": 1, "jan": 1,
    "february": 2, "feb": 2,
    "march": 3, "mar": 3,
    "april": 4, "apr": 4,
    "may": 5,
    "june": 6, "jun": 6,
    "july": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sep": 9,
    "october": 10, "oct": 10,
    "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}



def parse_ris_date(raw: Column) -> Column:
    """``Y/M/D`` with empty or missing parts; NULL when a part is not a number."""
    parts = F.split(raw, "/")
    part = lambda n: F.try_element_at(parts, F.lit(n))
    filled = lambda n: F.when(F.trim(part(n)) != "", part(n))
    bad = F.lit(False)
    for n in (1, 2, 3):
        bad = bad | (filled(n).isNotNull() & filled(n).try_cast("int").isNull())
    return F.when(~bad, partial_date(*[filled(n).try_cast("int") for n in (1, 2, 3)]))


def parse_year(raw: Column) -> Column:
    """The last four digits of the last run of at least four digits."""
    return F.regexp_extract(raw, r"^(.*)(\d{4,})", 2).try_cast("int")


def month_number(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(raw)))


def format_year(date: Column) -> Column:
    return date["year"].cast("string")


def expand_page_range(raw: Column) -> Column:
    """``10684-90`` to ``10684-10690``: an abbreviated right side that grows when filled up."""
    parts = F.split(raw, "-")
    left, right = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    low, high = left.try_cast("bigint"), right.try_cast("bigint")
    full = F.concat(F.left(left, F.greatest(F.length(left) - F.length(right), F.lit(0))), right)
    fits = (F.size(parts) == 2) & (high < low) & (full.try_cast("bigint") > low)
    return F.when(fits, F.concat(left, F.lit("-"), full)).otherwise(raw)


def page_range(start: Column, end: Column) -> Column:
    """From first and last page; equal pages give one. NULL without both."""
    return F.when(start == end, start).otherwise(F.concat(start, F.lit("-"), end))


def pages_label(pages: Column) -> Column:
    return F.concat(F.when(pages.contains("-"), "pages\u00a0").otherwise("page\u00a0"), pages)


def split_keywords(raw: Column) -> Column:
    return F.transform(F.split(raw, ";"), lambda k: F.trim(k))


def strip_source_prefix(raw: Column, source: str = "ISI") -> Column:
    """``ISI:xxx`` to ``xxx``; NULL for other sources."""
    found = F.regexp_extract(raw, f"^{source}:([^:]*)$", 1)
    return F.when(found != "", found)


def doi_from_article_no(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(text.startswith("DOI "), F.substring(text, 5, 2147483647))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")
