"""Exact duplicates by a tree merge of digest runs, in DataFrame operations only.

Every input partition is a leaf. Its run holds one row for each different text in it: digest,
number of copies, row that stays. In each round the runs of ``FAN`` neighbouring nodes meet in
their parent and are merged; a text repeated over a whole round is one row afterwards. After
about log(partitions) rounds the root run, itself spread over the cluster by digest, has one
row for each different text. The decision goes back down the same tree, so no join ever meets
all copies of a frequent text under one key: a node asks its parent, and a parent has ``FAN``
children at most.

Texts are equal when SHA-256, length in bytes and an independent 64-bit hash all agree; the
three are the merge key at every level, and of the rows that agree the one that stays is kept
as a single identifier (largest or smallest doc_id, then the first row in table order).

Null text counts as the empty text. Null doc_ids are less than any other and repeated rows of
one doc_id and text leave exactly one row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import text_column

FAN = 8
_KEY = ["_sha", "_length", "_hash"]
_ROW_BITS = 33  # monotonically_increasing_id: partition number above the row number


def _digests(docs: DataFrame) -> DataFrame:
    text = text_column()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "_row",
        F.shiftright("_row", _ROW_BITS).alias("_node0"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.octet_length(text).alias("_length"),
        F.xxhash64(text).alias("_hash"),
    )


def _best(largest: bool):
    """What a run keeps of equal texts: the identifier to stay and its row, as one ordered value."""
    doc = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    if largest:
        return F.max(F.struct(doc.alias("doc"), (-F.col("_row")).alias("row")))
    return F.min(F.struct(doc.alias("doc"), F.col("_row").alias("row")))


def _resolve(rows: DataFrame, largest: bool) -> DataFrame:
    """Adds ``_size`` and ``_best`` of its text to every digest row."""
    last = rows.agg(F.max("_node0")).first()[0] or 0  # one number
    merge = F.max if largest else F.min
    runs = [rows.groupBy("_node0", *_KEY).agg(F.count(F.lit(1)).alias("_n0"), _best(largest).alias("_b0"))]
    depth = 0
    while last > 0:
        last, depth = last // FAN, depth + 1
        runs.append(
            runs[-1]
            .withColumn(f"_node{depth}", F.floor(F.col(f"_node{depth - 1}") / FAN))
            .groupBy(f"_node{depth}", *_KEY)
            .agg(F.sum(f"_n{depth - 1}").alias(f"_n{depth}"), merge(f"_b{depth - 1}").alias(f"_b{depth}"))
        )
        runs[-1] = cut(runs[-1].sortWithinPartitions(f"_node{depth}", *_KEY))
    down = runs[-1].withColumnsRenamed({f"_n{depth}": "_size", f"_b{depth}": "_best"})
    for level in range(depth - 1, -1, -1):
        children = runs[level].select(
            f"_node{level}", *_KEY, F.floor(F.col(f"_node{level}") / FAN).alias(f"_node{level + 1}")
        )
        down = children.join(down, [f"_node{level + 1}", *_KEY]).drop(f"_node{level + 1}")
    return rows.join(down, ["_node0", *_KEY])


def classify(docs: DataFrame, largest: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(_digests(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())))
    found = _resolve(rows, largest)
    doc = F.col("_best.doc")
    return found.select(
        "doc_id",
        F.when(doc != -(1 << 63), doc).alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.abs(F.col("_best.row")) == F.col("_row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    # The numbered rows are written, as row numbers of a scan are only sure within one pass.
    table = cut(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    rows = table.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), "_row")
    kept = _resolve(cut(_digests(rows)), largest).filter(F.abs(F.col("_best.row")) == F.col("_row"))
    return table.join(kept.select("_row"), "_row", "left_semi").select("_doc.*")
