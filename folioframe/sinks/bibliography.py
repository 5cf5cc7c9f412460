"""Bibliographies as HTML or text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.style import escape


def html_lines(bibliography: DataFrame) -> DataFrame:
    """``(doc, pos, line)``: a table per document. The references are already HTML."""
    row = F.concat(
        F.lit("<tr><td>["), escape(F.col("cite_key")), F.lit("]</td><td>"),
        F.coalesce("reference", F.lit("")), F.lit("</td></tr>"),
    )
    rows = bibliography.select("doc", "pos", row.alias("line"))
    # head and foot of each document, placed before and after every position
    ends = rows.groupBy("doc").agg(F.max("pos").alias("_n"))
    frame = ends.select(
        "doc",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("<table>").alias("line")),
                F.struct((F.col("_n") + 1).alias("pos"), F.lit("</table>").alias("line")),
            )
        ).alias("_f"),
    ).select("doc", "_f.pos", "_f.line")
    return rows.unionByName(frame)


def text_lines(bibliography: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("cite_key"), F.lit("] "), F.coalesce("reference", F.lit("")))
    return bibliography.select("doc", "pos", line.alias("line"))


def write(lines: DataFrame, path: str) -> None:
    """Text files whose concatenation, in file order, is the bibliographies in order. A large
    document simply spans several files."""
    ordered = lines.repartitionByRange("doc", "pos").sortWithinPartitions("doc", "pos")
    ordered.select("line").write.text(path)
