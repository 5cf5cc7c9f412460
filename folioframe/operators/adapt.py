"""Seeing records through another schema. Keys stay as they are; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYED_COLUMNS, VALUE_COLUMNS, partial_date, txo, value

# Number of "article" in the document types of the BibTeX schema we ship.
ARTICLE = 1


class NoAdapter(ValueError):
    """No adapter leads from one schema to the other."""


def adapt_one_to_one(values: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Renames fields; fields without a target are dropped. The mapping is driver metadata."""
    spark = values.sparkSession
    table = spark.createDataFrame(list(fields.items()), "attr string, _target string")
    renamed = values.join(F.broadcast(table), "attr").withColumn("attr", F.col("_target"))
    return renamed.select(*KEYED_COLUMNS)


def _row_value() -> Column:
    return F.struct(*VALUE_COLUMNS)


def _out(attr: Column | str, body: Column) -> Column:
    name = F.lit(attr) if isinstance(attr, str) else attr
    return F.when(body.isNotNull(), F.struct(name.alias("attr"), body.alias("v")))


def _first_qual(name: str) -> Column:
    found = F.filter("quals", lambda q: (q["name"] == name) & (q["pos"] == 0))
    return F.try_element_at(found, F.lit(1))


def _emit(values: DataFrame, outputs: Column) -> DataFrame:
    rows = values.select("key", "pos", F.explode(outputs).alias("_o"))
    return rows.select("key", F.col("_o.attr").alias("attr"), "pos", *[F.col(f"_o.v.{c}").alias(c) for c in VALUE_COLUMNS])


def _qual_as_text(name: str) -> Column:
    q = _first_qual(name)
    return value("text", F.when(q["type"] == "text", q["text"]))


def _year_of_qual() -> Column:
    year = _first_qual("year")["text"].try_cast("int")
    return value("date", F.when(year.isNotNull(), partial_date(year)))


def _article() -> Column:
    return value("txo", txo("doctype", F.lit(ARTICLE)))


def _when_first(attr: str, outputs: list[Column]) -> Column:
    at = (F.col("attr") == attr) & (F.col("pos") == 0)
    return F.when(at, F.array_compact(F.array(*outputs)))


def pubmed_to_bibtex(values: DataFrame) -> DataFrame:
    """Each row yields its own targets, so one pass does: the id row also yields the document
    type, and the first journal row the fields held as its qualifiers."""
    kept = F.when(
        F.col("attr").isin("title", "author", "abstract", "journal"), F.array(_out(F.col("attr"), _row_value()))
    ).when(F.col("attr") == "pmid", F.array(_out("id", _row_value())))
    extra_id = _when_first("pmid", [_out("doctype", _article())])
    extra_journal = _when_first(
        "journal",
        [
            _out("date", _year_of_qual()),
            _out("volume", _qual_as_text("volume")),
            _out("number", _qual_as_text("issue")),
            _out("pages", _qual_as_text("pages")),
        ],
    )
    return _emit(values, _concat(kept, extra_id, extra_journal))


def wok_to_bibtex(values: DataFrame) -> DataFrame:
    """Document types all become articles; the first source gives the journal."""
    kept = F.when(
        F.col("attr").isin("title", "author", "abstract"), F.array(_out(F.col("attr"), _row_value()))
    ).when(F.col("attr") == "ut", F.array(_out("id", _row_value())))
    extra_type = _when_first("doctype", [_out("doctype", _article())])
    extra_source = _when_first(
        "source",
        [
            _out("journal", value("text", F.col("text"))),
            *[_out(n, _qual_as_text(n)) for n in ("pages", "volume", "number")],
            _out("date", _year_of_qual()),
        ],
    )
    return _emit(values, _concat(kept, extra_type, extra_source))


def _concat(*lists: Column) -> Column:
    # NULL lists are skipped: an array of the lists, compacted and flattened.
    return F.flatten(F.array_compact(F.array(*lists)))


ADAPTERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("pubmed", "bibtex"): pubmed_to_bibtex,
    ("wok", "bibtex"): wok_to_bibtex,
}


def adapt_schema(values: DataFrame, source: str, target: str, adapters=None) -> DataFrame:
    """The same schema: unchanged. Otherwise a direct adapter is needed."""
    if source == target:
        return values
    found = (ADAPTERS if adapters is None else adapters).get((source, target))
    if found is None:
        raise NoAdapter(f"no adapter from {source!r} to {target!r}")
    return found(values)
