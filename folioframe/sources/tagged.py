"""Tagged text files: RIS and ISI.

A record is one piece of text between end tags, so it arrives as one row, and its lines are
an array in that row. A field is the lines with its tags: no line leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import page_range, parse_ris_date, split_keywords, strip_source_prefix
from ..functions.names import person_from_comma
from ..model import VALUE, attributes, qual, to_values, txo, value
from .common import Ingest, keyed, read_text, tag_counts, violations

# RIS tags by the field they fill.
RIS_FIELDS = {
    "title": ("text", ("T1", "TI", "CT", "BT")),
    "note": ("text", ("N1", "AB")),
    "journal": ("text", ("JF", "JO", "JA", "J1", "J2")),
    "volume": ("text", ("VL",)),
    "issue": ("text", ("IS", "CP")),
    "city": ("text", ("CY",)),
    "publisher": ("text", ("PB",)),
    "abstract": ("text", ("N2",)),
    "issn": ("text", ("SN",)),
    "availability": ("text", ("AV",)),
    "address": ("text", ("AD",)),
    "id": ("id", ("ID",)),
    "url": ("url", ("UR",)),
    "author": ("person", ("A1", "AU")),
    "date": ("date", ("Y1", "PY")),
}
# Tags that are known and left out, silently or with a note in the log.
RIS_DROPPED = ("TY", "SP", "EP", "KW", "RP")
RIS_UNSUPPORTED = (
    "L1", "L2", "T2", "A2", "ED", "T3", "A3", "Y2", "U1", "U2", "U3", "U4", "U5", "M1", "M2", "M3", "L3", "L4",
)
# ISI tags that are known and left out.
ISI_DROPPED = ("PT", "DT", "C1", "RP", "BP")
ISI_FRAME = ("FN", "VR", "EF")
ISI_KNOWN = (
    "ID", "AU", "TI", "UT", "AB", "SO", "JI", "J9", "PY", "SE", "VL", "IS", "SN", "EP",
) + ISI_DROPPED
# ISI tags that qualify the source, with the type of the qualifier.
ISI_SOURCE = {
    "abbrev": ("text", ("JI", "J9")),
    "year": ("text", ("PY",)),
    "series": ("text", ("SE",)),
    "volume": ("text", ("VL",)),
    "number": ("text", ("IS",)),
    "issn": ("id", ("SN",)),
}
ISI_ARTICLE = 3  # the document type "@"
_MARK = "\u0001"


def _lines(spark: SparkSession, path: str, end: str, tagged: str, continued: str, joint: str) -> DataFrame:
    """``(key, lines ARRAY<STRUCT<i, tag, data>>)``; tag is NULL on a line that has none."""
    rows = read_text(spark, path, "\n" + end)
    # What follows the end tag on its line comes at the start of the next piece.
    text = F.when(F.col("value").rlike(tagged), F.col("value")).otherwise(
        F.regexp_replace("value", r"^[^\n]*\n?", "")
    )
    text = F.regexp_replace(text, r"\r?\n" + continued, joint)
    pieces = F.filter(F.split(text, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+$", "")) != "")
    rows = rows.withColumn("pieces", pieces)
    # The piece after the last end tag is empty or holds a closing frame only.
    frame = "^(?:" + "|".join(ISI_FRAME) + r")(?:\s|$)"
    rows = rows.withColumn("pieces", F.filter("pieces", lambda line: ~line.rlike(frame)))
    rows = keyed(rows.filter(F.size("pieces") > 0).drop("value"))
    line = lambda x, i: F.struct(
        i.alias("i"),
        F.when(x.rlike(tagged), F.left(x, F.lit(2))).alias("tag"),
        F.regexp_replace(F.regexp_extract(x, tagged, 1), r"\r$", "").alias("data"),
    )
    return rows.select("key", F.transform("pieces", line).alias("lines"))


def _with(lines: Column, tags: tuple[str, ...]) -> Column:
    return F.filter(lines, lambda line: line["tag"].isin(*tags))


def _values(lines: Column, tags: tuple[str, ...], make: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(_with(lines, tags), lambda line: make(line["data"]).cast(VALUE)))


def _parse(kind: str) -> Callable[[Column], Column]:
    if kind == "person":
        return lambda data: value("person", person_from_comma(data, "ris"))
    if kind == "date":
        return lambda data: value("date", parse_ris_date(data))
    return lambda data: value(kind, data)


def _loose_lines(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.explode("lines").alias("_l")).select("key", "_l.tag", "_l.data", "_l.i")


def ingest_ris(
    spark: SparkSession, path: str, hooks: dict[str, tuple[str, tuple[str, ...]]] | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> Ingest:
    """Reads RIS. ``hooks`` adds or replaces fields (field to type and tags); ``keep`` is a
    condition on the lines of a record, to leave records out."""
    fields = RIS_FIELDS | (hooks or {})
    rows = _lines(spark, path, "ER  - ", r"^\w\w\s\s-\s([\s\S]*)", r"\s{6}", " ")
    if keep is not None:
        rows = rows.filter(keep(F.col("lines")))
    lines = F.col("lines")
    records = rows.select(
        "key", attributes(**{f: _values(lines, tags, _parse(kind)) for f, (kind, tags) in fields.items()}).alias("attrs")
    )
    mapped = tuple(t for _, tags in fields.values() for t in tags)
    loose = _loose_lines(rows)
    dates = loose.filter(F.col("tag").isin(*fields["date"][1]) & parse_ris_date(F.col("data")).isNull())
    wrong = (
        violations(loose.filter(F.col("tag").isNull()), F.lit(None), "unexpected_data", F.col("i"))
        .unionByName(violations(
            loose.filter(~F.col("tag").isin(*mapped, *RIS_DROPPED, *RIS_UNSUPPORTED)), F.lit(None), "unknown_tag", F.col("tag")
        ))
        .unionByName(violations(dates, F.lit("date"), "unreadable", F.col("data")))
        .unionByName(violations(
            rows.filter(~F.exists("lines", lambda line: line["tag"] == "TY")), F.lit(None), "no_start", F.lit("TY")
        ))
    )
    left_out = tuple(t for t in RIS_UNSUPPORTED if t not in mapped)
    return Ingest(to_values(records), wrong, tag_counts(loose.filter(F.col("tag").isin(*left_out)), "tag"))


def _isi_sources(lines: Column) -> Column:
    """The sources, each with the qualifiers that follow it (the first: also those before)."""
    sources = _with(lines, ("SO",))
    start = F.try_element_at(_with(lines, ("BP",)), F.lit(1))
    ends = F.filter(_with(lines, ("EP",)), lambda line: line["i"] > start["i"])

    def source(so: Column, n: Column) -> Column:
        following = F.try_element_at(sources, n + 2)["i"]

        def mine(line: Column) -> Column:
            after = (n == 0) | (line["i"] > so["i"])
            return after & (following.isNull() | (line["i"] < following))

        lists = []
        for name, (kind, tags) in ISI_SOURCE.items():
            found = F.filter(_with(lines, tags), mine)
            lists.append(_placed(found, name, kind, lambda line: line["data"]))
        pages = F.filter(ends, mine)
        lists.append(_placed(pages, "pages", "text", lambda line: page_range(start["data"], line["data"])))
        return value("text", F.replace(so["data"], F.lit(_MARK), F.lit("\n")), F.concat(*lists))

    return F.transform(sources, source)


def _placed(lines: Column, name: str, kind: str, data: Callable[[Column], Column]) -> Column:
    """Qualifiers from lines, numbered in order."""
    return F.transform(lines, lambda line, n: qual(name, kind, data(line)).withField("pos", n))


def ingest_isi(spark: SparkSession, path: str) -> Ingest:
    """Reads ISI into the Web of Knowledge schema."""
    rows = _lines(spark, path, "ER", r"^\w\w(?:\s([\s\S]*))?$", r"\s{3}", _MARK)
    lines = F.col("lines")
    joined = lambda data: F.replace(data, F.lit(_MARK), F.lit("\n"))
    text = lambda *tags: _values(lines, tags, lambda data: value("text", joined(data)))
    # The last author line counts, its names come one per continuation line.
    authors = F.try_element_at(_with(lines, ("AU",)), F.lit(-1))["data"]
    people = F.transform(F.split(authors, _MARK), lambda n: value("person", person_from_comma(n, "isi")))
    keywords = F.flatten(
        F.transform(_with(lines, ("ID",)), lambda line: F.transform(split_keywords(joined(line["data"])), lambda k: value("text", k)))
    )
    article = F.filter(_with(lines, ("PT",)), lambda line: line["data"] == "J")
    doctype = F.transform(article, lambda _: value("txo", txo("doctype", F.lit(ISI_ARTICLE))))
    records = rows.select(
        "key",
        attributes(
            **{
                "doctype": doctype,
                "keyword": keywords,
                "author": F.coalesce(people, F.array().cast(f"array<{VALUE}>")),
                "title": text("TI"),
                "abstract": text("AB"),
                "ut": _values(lines, ("UT",), lambda data: value("id", strip_source_prefix(data))),
                "source": _isi_sources(lines),
            }
        ).alias("attrs"),
    )
    loose = _loose_lines(rows)
    source_tags = tuple(t for _, tags in ISI_SOURCE.values() for t in tags)
    orphans = rows.filter(
        ~F.exists("lines", lambda line: line["tag"] == "SO") & F.exists("lines", lambda line: line["tag"].isin(*source_tags))
    )
    wrong = (
        violations(loose.filter(F.col("tag").isNull()), F.lit(None), "unexpected_data", F.col("i"))
        .unionByName(violations(loose.filter((F.col("tag") == "PT") & (F.col("data") != "J")), F.lit("doctype"), "unknown_item", F.col("data")))
        .unionByName(violations(orphans, F.lit("source"), "incomplete", F.lit("source")))
        .unionByName(violations(rows.filter(~F.exists("lines", lambda line: line["tag"] == "PT")), F.lit(None), "no_start", F.lit("PT")))
    )
    return Ingest(to_values(records), wrong, tag_counts(loose.filter(~F.col("tag").isin(*ISI_KNOWN)), "tag"))
