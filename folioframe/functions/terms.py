"""Index terms and sort keys of typed values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import let

# What separates words: everything but letters, digits and the underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"


def words(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(F.lower(text) if lower else text, F.lit(""))
    return F.filter(F.split(text, NON_WORD), lambda t: t != "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_page(url: Column) -> Column:
    """The path of a url without the extension of its last component."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    return F.regexp_replace(path, r"((?:^|/)\.*[^/.][^/]*)\.[^./]*$", "$1")


def url_words(url: Column, lower: bool = False) -> Column:
    """Words of host and page. The case is kept, as the reference semantics have it."""
    return F.concat(words(url_host(url), lower), words(url_page(url), lower))


def value_terms(v, url_lower: bool = False) -> Column:
    """What full text search sees of a value; ``v`` maps a part name to its Column."""
    none = F.array().cast("array<string>")
    return (
        F.when(v["type"] == "text", words(v["text"]))
        .when(v["type"] == "person", F.concat(words(v["person"]["first"]), words(v["person"]["last"])))
        .when(v["type"] == "url", url_words(v["text"], url_lower))
        .when(v["type"] == "txo", F.array(F.concat_ws("/", v["txo"]["grp"], v["txo"]["id"].cast("string"))))
        .otherwise(none)
    )


def has_word(text: Column, word: str, lower: bool = True) -> Column:
    """Is ``word`` one of the words of ``text``: tests the text without splitting it."""
    word = word.lower()
    if not re.fullmatch(r"\w+", word):
        return F.lit(False)
    # The literal comes first, so that the scan for it is a plain comparison; only where it
    # is found are its neighbours looked at.
    inside = r"[\p{L}\p{N}_]"
    literal = re.escape(word)
    pattern = f"{literal}(?<!{inside}{literal})(?!{inside})"
    text = F.coalesce(F.lower(text) if lower else text, F.lit(""))
    return let(text, lambda t: t.contains(word) & t.rlike(pattern))


def value_has_word(v, word: str, url_lower: bool = False) -> Column:
    """``word`` is among ``value_terms``."""
    exact = F.concat_ws("/", v["txo"]["grp"], v["txo"]["id"].cast("string")) == word.lower()
    hit = (
        F.when(v["type"] == "text", has_word(v["text"], word))
        .when(v["type"] == "person", has_word(v["person"]["first"], word) | has_word(v["person"]["last"], word))
        .when(
            v["type"] == "url",
            has_word(url_host(v["text"]), word, url_lower) | has_word(url_page(v["text"]), word, url_lower),
        )
        .when(v["type"] == "txo", exact)
    )
    return F.coalesce(hit, F.lit(False))


def sort_key(v) -> Column:
    """The key a value sorts by, as a string that compares like the typed key."""
    text = lambda c: F.coalesce(c, F.lit(""))
    person, date = v["person"], v["date"]
    digits = lambda c, n: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), n, "0")
    return (
        F.when(v["type"] == "text", F.lower(v["text"]))
        .when(
            v["type"] == "person",
            F.lower(F.concat(text(person["last"]), F.lit("\u0000"), text(person["first"]))),
        )
        .when(v["type"] == "date", F.concat(digits(date["year"], 4), digits(date["month"], 2), digits(date["day"], 2)))
        .when(v["type"] == "txo", F.concat_ws("/", v["txo"]["grp"], v["txo"]["id"].cast("string")))
        .otherwise(v["text"])
    )


class _RowParts:
    def __getitem__(self, name: str) -> Column:
        return F.col(name)


# The parts of a value in a row of the long form, to pass as ``v`` above.
ROW = _RowParts()
