"""What all readers share: keys in file order, the result of an import."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

XML_OPTIONS = {
    "ignoreNamespace": "true",
    "ignoreSurroundingSpaces": "false",
    "columnNameOfCorruptRecord": "_malformed",
    "mode": "PERMISSIVE",
}


class Ingest(NamedTuple):
    """``records`` is nested, ``values`` long; a reader fills the one that is natural for it."""

    values: DataFrame
    violations: DataFrame  # key, attr, pos, rule, detail
    log: DataFrame  # tag, n: input that was left out

    def result_set(self, rs_id: int) -> DataFrame:
        """The set of the imported keys."""
        return self.values.select(F.lit(rs_id).cast("bigint").alias("rs_id"), "key").distinct()


def file_place() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ]


def keyed(rows: DataFrame, first_key: int = 1, index: str | None = None, keep_file: bool = False) -> DataFrame:
    """Adds ``key``: consecutive numbers in file order.

    A task reads one block of a file after the other, in order, so the place of a row is its
    block and its place there. Only the blocks, one row each, are put in global order; the
    records are not shuffled. ``index`` names a column with the place in the block, from 0, if
    the rows bring one; otherwise it is taken from the running row id. Rows where it is NULL
    are no records; they get no key.
    """
    rows = cut(rows.withColumn("_mid", F.monotonically_increasing_id()))
    place = F.col("_mid") if index is None else F.col(index)
    first = F.min(place) if index is None else F.lit(0)
    blocks = rows.groupBy("_file", "_block").agg(F.count(place).alias("_n"), first.alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    key = F.col("_offset") + place - F.col("_first") + first_key
    out = rows.join(offsets, ["_file", "_block"]).withColumn("key", key).drop("_offset", "_first")
    return out if keep_file else out.drop("_file", "_block", "_mid")


def read_text(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """One row per separated piece of text, with its place."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(*file_place(), "value")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per element, with its place.

    The text source cuts at the closing tag, so one large file is read by many tasks, and it
    does not matter whether a file has a root element. The schema is explicit: inference
    would read everything twice.
    """
    rows = read_text(spark, path, f"</{row_tag}>")
    # Split, as a pattern that runs on to the end of the text takes longer than the reading of the XML.
    rest = F.try_element_at(F.split("value", rf"<{row_tag}(?=[\s>])", 2), F.lit(2))
    rows = rows.withColumn("_rest", rest).filter(F.col("_rest").isNotNull()).drop("value")
    rows = rows.withColumn("_xml", F.concat(F.lit(f"<{row_tag}"), "_rest", F.lit(f"</{row_tag}>")))
    parsed = F.from_xml("_xml", f"{schema}, _malformed string", XML_OPTIONS)
    return rows.select("_file", "_block", parsed.alias("_p")).select("_file", "_block", "_p.*")


def read_xml_document(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of a small, well-formed file, where an element may hold others of its name."""
    return spark.read.format("xml").option("rowTag", row_tag).options(**XML_OPTIONS).schema(schema).load(path)


def malformed(rows: DataFrame) -> DataFrame:
    return violations(rows.filter(F.col("_malformed").isNotNull()), F.lit(None), "malformed", F.col("_malformed"))


def violations(rows: DataFrame, attr: Column, rule: str, detail: Column, pos: Column | None = None) -> DataFrame:
    position = F.lit(None) if pos is None else pos
    return rows.select(
        "key", attr.cast("string").alias("attr"), position.cast("int").alias("pos"),
        F.lit(rule).alias("rule"), detail.cast("string").alias("detail"),
    )


def tag_counts(rows: DataFrame, tag: str) -> DataFrame:
    return rows.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
