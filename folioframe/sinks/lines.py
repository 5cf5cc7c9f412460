"""Writing records as lines of text.

A value is a line, so no record is gathered in a row: the lines are range-partitioned by key
and sorted. Every file holds whole records, in key order over the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = -1, 2147483647


def escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def quoted(text: Column) -> Column:
    """An XML attribute value with its quotes; line breaks and tabs as references."""
    for mark, entity in (('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text if mark != '"' else escape(text), F.lit(mark), F.lit(entity))
    return F.concat(F.lit('"'), text, F.lit('"'))


def optional(prefix: str, text: Column, suffix: str = "") -> Column:
    """``prefix text suffix``, or nothing when there is no text."""
    return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(prefix), text, F.lit(suffix))).otherwise("")


def frame(keys: DataFrame, opening: Column, closing: Column) -> DataFrame:
    """First and last line of each record."""
    ends = F.array(
        F.struct(F.lit(0).alias("part"), opening.alias("line")), F.struct(F.lit(9).alias("part"), closing.alias("line"))
    )
    return keys.select("key", F.explode(ends).alias("_e")).select(
        "key", "_e.part", F.lit("").alias("field"), F.lit(0).alias("pos"), F.col("_e.line").alias("line")
    )


def ordered(lines: DataFrame) -> DataFrame:
    order = ("key", "part", "field", "pos")
    # By key alone: readers take files one by one, so a record may not go over a border.
    return lines.repartitionByRange("key").sortWithinPartitions(*order)


def write(lines: DataFrame, path: str) -> None:
    """``lines`` has key, part, field, pos, line."""
    ordered(lines).select("line").write.text(path)


def document(lines: DataFrame, head: str, foot: str) -> DataFrame:
    """Adds the first and the last line of the whole output, such as a root element."""
    ends = F.array(
        *[
            F.struct(F.lit(key).cast("bigint").alias("key"), F.lit(text).alias("line"))
            for key, text in ((-(2**63), head), (2**63 - 1, foot))
        ]
    )
    spark = lines.sparkSession
    rows = spark.range(1).select(F.explode(ends).alias("_e")).select(
        "_e.key", F.lit(0).alias("part"), F.lit("").alias("field"), F.lit(0).alias("pos"), "_e.line"
    )
    return lines.unionByName(rows)
