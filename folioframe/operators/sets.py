"""Result sets: named, distinct sets of record keys, as key tables.

``member`` is ``(rs_id, key)``, ``meta`` is ``(rs_id, name)``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import payload_text


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").distinct().join(b.select("key"), "key", "left_anti")


def complement(a: DataFrame, everything: DataFrame) -> DataFrame:
    return minus(everything, a)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All keys of both, once; the inputs stay as they are."""
    return union(a, b)


def of(keys: DataFrame, rs_id: int) -> DataFrame:
    """Members of a new set."""
    return keys.select(F.lit(rs_id).cast("bigint").alias("rs_id"), F.col("key").cast("bigint").alias("key")).distinct()


def select(member: DataFrame, rs_id: int) -> DataFrame:
    return member.filter(F.col("rs_id") == rs_id).select("key")


def add(member: DataFrame, rs_id: int, keys: DataFrame) -> DataFrame:
    """Adding a key twice changes nothing."""
    return member.select("rs_id", "key").union(of(keys, rs_id)).distinct()


def remove(member: DataFrame, rs_id: int, keys: DataFrame) -> DataFrame:
    return member.join(of(keys, rs_id), ["rs_id", "key"], "left_anti")


def members(values: DataFrame, keys: DataFrame) -> DataFrame:
    """The records (or values) of a set."""
    return values.join(keys.select("key").distinct(), "key", "left_semi")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of other keys, columns in their order."""
    return rows.join(gone.select("key").distinct(), "key", "left_anti").select(*rows.columns)


def cascade(member: DataFrame, deleted: DataFrame) -> DataFrame:
    """A deleted record leaves every set."""
    return without(member, deleted)


def destroy(values: DataFrame, index: DataFrame, member: DataFrame, rs_id: int):
    """Deletes the records of a set from the values, the index and all sets."""
    gone = select(member, rs_id).distinct()
    return tuple(without(t, gone) for t in (values, index, member))


def sizes(member: DataFrame) -> DataFrame:
    return member.groupBy("rs_id").agg(F.count(F.lit(1)).alias("n"))


# --- stored sets ---------------------------------------------------------------------------


# Every save writes its members into a folder of its own, and then the one-row table that names
# the set and that folder. Until then readers see the old members, from then on the new ones;
# an empty set is a name without a folder.

_META = "name string, version string, rs_id bigint"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _meta(spark: SparkSession, path: str) -> DataFrame:
    # The folder exists only once a set has been saved.
    try:
        return spark.read.schema(_META).parquet(f"{path}/meta")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _META)


def save(path: str, rs_id: int, name: str, keys: DataFrame) -> None:
    """Writes one set with its name; other sets in the same place stay."""
    spark = keys.sparkSession
    old = [r.version for r in _meta(spark, path).filter(F.col("rs_id") == rs_id).collect()]
    version = uuid.uuid4().hex
    of(keys, rs_id).select("key").write.parquet(f"{path}/member/rs_id={rs_id}/version={version}")
    meta = spark.createDataFrame([(name, version, rs_id)], _META)
    switch = meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    switch.partitionBy("rs_id").parquet(f"{path}/meta")
    for gone in old:
        _delete(spark, f"{path}/member/rs_id={rs_id}/version={gone}")


def load(spark: SparkSession, path: str, rs_id: int | None = None) -> DataFrame:
    meta = _meta(spark, path)
    meta = meta if rs_id is None else meta.filter(F.col("rs_id") == rs_id)
    # Folders are partitions, and the names of sets are few: only the folders in force are read.
    member = spark.read.schema("key bigint, rs_id bigint, version string").parquet(f"{path}/member")
    return member.join(meta.select("rs_id", "version"), ["rs_id", "version"]).select("rs_id", "key")


def listing(spark: SparkSession, path: str) -> DataFrame:
    return _meta(spark, path).select("rs_id", "name")


def drop(spark: SparkSession, path: str, rs_id: int) -> None:
    """Forgets a set, name first; its records stay."""
    for part in ("meta", "member"):
        _delete(spark, f"{path}/{part}/rs_id={rs_id}")


# --- partition of a set --------------------------------------------------------------------


def collate(values: DataFrame, field: str, keys: DataFrame) -> DataFrame:
    """Splits ``keys`` by the first value of ``field``: one ``(value, key)`` row per record,
    with NULL for records without the field. Long form, as one part may be most of the set."""
    first = values.filter(F.col("attr") == field).groupBy("key").agg(F.min_by(payload_text(), "pos").alias("value"))
    return keys.select("key").distinct().join(first, "key", "left").select("value", "key")


def collate_nested(records: DataFrame, field: str) -> DataFrame:
    """The same from nested records, without a join."""
    first = F.try_element_at(F.try_element_at("attrs", F.lit(field)), F.lit(1))
    return records.select(first.alias("_v"), "key").select(payload_text("_v").alias("value"), "key")


def part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def field_arity(values: DataFrame) -> DataFrame:
    """Number of values of each field of each record."""
    return values.groupBy("key", "attr").agg(F.count(F.lit(1)).alias("n"))
