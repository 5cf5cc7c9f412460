"""Entries removed from BibTeX files, every other byte left where it is."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scan
from ..session import cut
from ..sources import bibtex
from ..sources.common import file_place

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECE = ["_file", "_block", "_mid"]
_SPANS = "_file string, _block bigint, _mid bigint, citation_key string, open boolean, s int, e int"
_HEAD = re.compile(r"^[^\S\n]*@[^\S\n]*(\w+)\s*([{(])\s*([^\s,{}()]*)", re.M)
_MARK = re.compile(r"\\.|([{}()])", re.S)
_NO_ENTRY = {"comment", "string", "preamble"}


def _close(text: str, at: int, depth: int, last: str) -> int | None:
    """Where the text in ``depth`` braces ends that goes on at ``at``; ``last`` is its closing mark."""
    for m in _MARK.finditer(text, at):
        mark = m.group(1)
        if mark == last and depth == (mark == "}"):
            return m.end()
        depth += (mark == "{") - (mark == "}")
    return None


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each piece; the parts of one that goes over several pieces have a span in each,
    without a key after the first."""
    for batch in batches:
        rows: list[tuple] = []
        for *place, text, goes_on, inside in zip(*(batch[c] for c in [*_PIECE, "value", "goes_on", "inside"])):
            at = 0
            if goes_on:
                end = _close(text, 0, int(inside), "}")
                rows.append((*place, None, False, 0, len(text) if end is None else end))
                at = rows[-1][-1]
            while (m := _HEAD.search(text, at)) is not None:
                end = _close(text, m.start(2) + 1, m.group(2) == "{", "}" if m.group(2) == "{" else ")")
                key = None if m.group(1).lower() in _NO_ENTRY else m.group(3)
                rows.append((*place, key, end is None, m.start(), len(text) if end is None else end))
                at = rows[-1][-1]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPANS.split(", ")])


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the ordered spans. What is left of a line that held nothing else goes too."""
    whole = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def drop(state: Column, span: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, span["s"] - state["at"])
        own_line = (kept == "") | kept.endswith("\n")
        ends_line = F.substring(text, span["e"] + 1, F.lit(1)) == "\n"
        end = span["e"] + F.when(own_line & ends_line, 1).otherwise(0)
        return F.struct(F.concat(state["out"], kept).alias("out"), end.cast("int").alias("at"))

    rest = F.aggregate(spans, whole, drop)
    return F.concat(rest["out"], F.substring(text, rest["at"] + 1, F.length(text)))


def purge_files(spark: SparkSession, path: str, cited: DataFrame, out: str) -> DataFrame:
    """Writes the BibTeX files of ``path`` to ``out`` without the entries whose key is in
    ``cited(citation_key)``; returns the removed ``file, citation_key``.

    A file is a folder ``file=<name>`` of ``out``; its parts, by name, are the file. Comments, macros,
    blank lines and text between entries stay, as do entries that never close. All entries of a
    repeated key go; null keys match nothing. Only a missing line end at the end of a file is added.
    Files of one name from different folders would be one, so they are refused.

    Pieces between line starts with ``@`` are read by many tasks from one file. Where an entry goes over pieces
    and blocks, running sums of braces tell its parts; they and the spans of entries are numbers,
    and the text is shuffled once, to be written in order.
    """
    value = F.when((F.col("_block") == 0) & (F.col("_n") == F.col("_mid")), F.col("value")).otherwise(F.concat(F.lit("@"), "value"))
    raw = spark.read.option("lineSep", "\n@").text(path).select(*file_place(), "value")
    raw = cut(raw.withColumn("_mid", F.monotonically_increasing_id()))
    files = raw.select("_file").distinct().select("_file", F.element_at(F.split("_file", "/"), -1).alias("file"))
    files = cut(files)
    twice = files.groupBy("file").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are named {twice[0].file}")
    first = raw.filter("_block = 0").groupBy("_file").agg(F.min("_mid").alias("_n"))
    pieces = raw.join(first, "_file", "left").withColumn("value", value).drop("_n")

    braces = bibtex._net_braces()
    if raw.filter(braces != 0).isEmpty():  # every piece is closed, as in most files
        begun = {"own_block": F.col("_block"), "own_mid": F.col("_mid"), "goes_on": F.lit(False), "inside": F.lit(0)}
        rows = raw.select(*_PIECE).withColumns(begun)
        joined = pieces.withColumns(begun)
    else:
        before = F.col("_p") - F.col("_d")
        begun = {"own_block": F.col("_block"), "own_mid": F.col("_mid"), "base": before}
        begun = {name: ("last", F.when(F.col("_first"), c)) for name, c in begun.items()}
        rows = scan.unplace(scan.run(bibtex._starts(raw.select(*_PIECE, braces.alias("_d"))), ["_file"], begun))
        rows = rows.withColumns({"goes_on": ~F.col("_first"), "inside": before - F.col("base")})
        rows = cut(rows.filter(~F.col("_lone")).select(*_PIECE, "own_block", "own_mid", "goes_on", "inside"))
        joined = pieces.join(rows, _PIECE)
    spans = cut(joined.select(*_PIECE, "value", "goes_on", "inside").mapInPandas(_spans, _SPANS))
    keys = cited.select(F.col("citation_key").cast("string").alias("citation_key")).distinct()
    gone = cut(spans.join(keys, "citation_key", "left_semi"))
    # The parts of an entry in later pieces go with its first.
    opened = gone.filter("open").select("_file", F.col("_block").alias("own_block"), F.col("_mid").alias("own_mid"))
    parts = rows.filter("goes_on").join(opened, ["_file", "own_block", "own_mid"], "left_semi").select(*_PIECE)
    more = spans.filter("s = 0 AND citation_key IS NULL").join(parts, _PIECE, "left_semi")
    cuts = gone.select(*_PIECE, "s", "e").unionByName(more.select(*_PIECE, "s", "e"))
    cuts = cuts.groupBy(*_PIECE).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))

    last = raw.groupBy("_file").agg(F.max(F.struct("_block", "_mid")).alias("_last"))
    left = pieces.join(cuts, _PIECE, "left").join(last, "_file").join(files, "_file")
    # An entry that ends with its piece leaves no empty line behind.
    text = F.when(F.col("spans").isNull(), F.col("value")).otherwise(_without(F.concat("value", F.lit("\n")), F.col("spans")))
    lines = F.split(F.when(F.col("spans").isNull(), F.concat(text, F.lit("\n"))).otherwise(text), "\n")
    lines = F.slice(lines, 1, F.size(lines) - 1)  # every piece now ends with a line end
    at_end = (F.col("_last._block") == F.col("_block")) & (F.col("_last._mid") == F.col("_mid"))
    # The last piece has its own line end already, if the file has one.
    extra = at_end & F.col("value").endswith("\n") & (F.size(lines) > 0)
    lines = F.when(extra, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    placed = left.repartitionByRange("file", "_block", "_mid").sortWithinPartitions("file", "_block", "_mid")
    placed.select("file", F.explode(lines).alias("value")).write.partitionBy("file").text(out)
    return gone.join(files, "_file").select("file", "citation_key")
