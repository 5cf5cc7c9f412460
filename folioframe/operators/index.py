"""The inverted index: ``(term, key)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import ROW, value_terms


def index_rows(values: DataFrame, url_lower: bool = False) -> DataFrame:
    """Distinct ``(term, key)``: repeats inside a value go before the shuffle."""
    terms = values.select("key", F.explode(F.array_distinct(value_terms(ROW, url_lower))).alias("term"))
    return terms.select("term", "key").distinct()


def index_rows_nested(records: DataFrame) -> DataFrame:
    """The same from nested records: no shuffle at all, since a record is one row."""
    terms = F.flatten(F.transform(F.flatten(F.map_values("attrs")), lambda v: value_terms(v)))
    return records.select(F.explode(F.array_distinct(terms)).alias("term"), "key")


def write_index(rows: DataFrame, path: str) -> None:
    """Sorted by term over the whole table, so that a lookup reads few row groups. The range
    includes the key: the entries of a very frequent term fill as many files as they need."""
    rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, key bigint").parquet(path)


def lookup(index: DataFrame, word: str) -> DataFrame:
    return index.filter(F.col("term") == word.lower()).select("key")


def update(index: DataFrame, changed: DataFrame, values: DataFrame) -> DataFrame:
    """Takes all terms of the ``changed`` keys out and the terms of ``values`` in. For a
    deletion pass no values."""
    return index.join(changed.select("key").distinct(), "key", "left_anti").select("term", "key").unionByName(
        index_rows(values)
    )


def term_stats(index: DataFrame) -> DataFrame:
    """Records per term."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"))


def record_stats(index: DataFrame) -> DataFrame:
    """Terms per record."""
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("n_terms"))
