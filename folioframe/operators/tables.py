"""Maintenance of record tables: add, update, delete, validate, compare, build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEYED_COLUMNS, VALUE_COLUMNS, Schema, payload_text, union_all
from ..plans import scan
from ..session import cut
from .sets import without


def keys_of(values: DataFrame) -> DataFrame:
    return values.select("key").distinct()


# --- adding, replacing, deleting -----------------------------------------------------------


def allocate_keys(feed: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys for new records, in feed order.

    ``feed`` has a total order ``seq`` and an optional ``proposed`` key. Without a proposal a
    record takes the next key. A proposal is kept and moves the counter past it. Returns the
    feed with ``key`` for the accepted rows, and the rejected rows, whose key is taken.

    The counter after row i is n + max(start, max over proposals (p + 1 - n at p)), where n
    counts the rows without a proposal so far: two running aggregates, no sequential pass.
    """
    start = existing.agg((F.coalesce(F.max("key"), F.lit(0)) + 1).cast("bigint").alias("_start"))
    rows = scan.place(feed, ["seq"])
    free = F.when(F.col("proposed").isNull(), F.lit(1))
    rows = scan.run(rows, [], {"_n": ("count", free)})
    lift = F.when(F.col("proposed").isNotNull(), F.col("proposed") + 1 - F.col("_n"))
    rows = scan.unplace(scan.run(rows, [], {"_lift": ("max", lift)}))
    # start is a single row
    rows = rows.join(F.broadcast(start)).withColumn(
        "key", F.coalesce(F.col("proposed"), F.greatest("_start", "_lift") + F.col("_n") - 1)
    )
    firsts = rows.groupBy("key").agg(F.min("seq").alias("_winner"))
    taken = existing.select("key").distinct().withColumn("_taken", F.lit(True))
    judged = rows.join(firsts, "key").join(taken, "key", "left")
    ok = F.col("_taken").isNull() & (F.col("seq") == F.col("_winner"))
    wanted = feed.columns + ["key"]
    return judged.filter(ok).select(*wanted), judged.filter(~ok).select(*wanted)


def update_records(values: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces whole records. Returns the new values, and the keys that do not exist."""
    existing = keys_of(values)
    accepted = new.join(existing, "key", "left_semi")
    missing = keys_of(new).join(existing, "key", "left_anti")
    kept = values.join(keys_of(new), "key", "left_anti")
    return kept.unionByName(accepted), missing


def delete_records(values: DataFrame, index: DataFrame, member: DataFrame, deleted: DataFrame):
    """Deletes from the values, the index and all sets."""
    return tuple(without(t, deleted) for t in (values, index, member))


# --- validation ----------------------------------------------------------------------------


def drop_empty(records: DataFrame) -> DataFrame:
    """NULL values, empty lists and NULL qualifiers vanish from nested records."""
    # A NULL list stays NULL under filter(), and size(NULL) > 0 is not true.
    kept = F.transform_values("attrs", lambda _, vs: F.filter(vs, lambda v: v.isNotNull()))
    kept = F.transform_values(
        kept,
        lambda _, vs: F.transform(vs, lambda v: v.withField("quals", F.filter(v["quals"], lambda q: q.isNotNull()))),
    )
    return records.withColumn("attrs", F.map_filter(kept, lambda _, vs: F.size(vs) > 0))


def validate(values: DataFrame, schema: Schema, items: DataFrame, strict: bool = False) -> DataFrame:
    """Every rule a value breaks, as ``(key, attr, pos, rule, detail)``.

    Rules: unknown_attribute, incomplete, wrong_type, wrong_group, unknown_item, too_many,
    unknown_qualifier, wrong_qualifier_type; ``strict`` also checks qualifier taxonomies.
    The tables of the schema are driver metadata, and small.
    """
    spark = values.sparkSession
    attrs = schema.attr_table(spark).select(
        "attr", F.col("type").alias("_type"), F.col("grp").alias("_grp"), F.col("max_n").alias("_max")
    )
    known = items.select(F.col("grp").alias("_igrp"), F.col("id").alias("_iid"), F.lit(True).alias("_known"))
    v = values.join(F.broadcast(attrs), "attr", "left").join(
        known, (F.col("txo.grp") == F.col("_igrp")) & (F.col("txo.id") == F.col("_iid")), "left"
    )
    has = F.col("_type").isNotNull()
    typed = has & (F.col("type") == F.col("_type"))

    def rule(name, condition, detail):
        return F.when(condition, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))

    group_ok = F.col("txo.grp") == F.col("_grp")
    broken = F.array_compact(
        F.array(
            rule("unknown_attribute", ~has, F.col("attr")),
            rule("incomplete", has & F.col("type").isNull(), F.col("attr")),
            rule("wrong_type", has & (F.col("type") != F.col("_type")), F.col("type")),
            rule("wrong_group", typed & (F.col("type") == "txo") & ~group_ok, F.col("txo.grp")),
            rule(
                "unknown_item",
                typed & (F.col("type") == "txo") & group_ok & F.col("_known").isNull(),
                F.concat_ws("/", "txo.grp", F.col("txo.id").cast("string")),
            ),
        )
    )
    by_value = v.select("key", "attr", "pos", F.explode(broken).alias("_r"))
    by_value = by_value.select("key", "attr", "pos", "_r.rule", "_r.detail")

    limited = attrs.filter(F.col("_max").isNotNull())
    counts = values.groupBy("key", "attr").agg(F.count(F.lit(1)).alias("_n"))
    too_many = (
        counts.join(F.broadcast(limited), "attr")
        .filter(F.col("_n") > F.col("_max"))
        .select("key", "attr", F.lit(None).cast("int").alias("pos"), F.lit("too_many").alias("rule"),
                F.col("_n").cast("string").alias("detail"))
    )

    quals = schema.qual_table(spark).select(
        "attr", "qual", F.col("type").alias("_qtype"), F.col("grp").alias("_qgrp")
    )
    q = values.join(F.broadcast(attrs.select("attr")), "attr", "left_semi").select(
        "key", "attr", "pos", F.explode("quals").alias("_q")
    )
    q = q.select("*", F.col("_q.name").alias("qual")).join(F.broadcast(quals), ["attr", "qual"], "left")
    bad_qual = (
        F.when(F.col("_qtype").isNull(), F.lit("unknown_qualifier"))
        .when(F.col("_q.type") != F.col("_qtype"), F.lit("wrong_qualifier_type"))
    )
    if strict:
        bad_qual = bad_qual.when(
            (F.col("_qtype") == "txo") & (F.col("_q.txo.grp") != F.col("_qgrp")), F.lit("wrong_qualifier_group")
        )
    by_qual = q.select("key", "attr", "pos", bad_qual.alias("rule"), F.col("qual").alias("detail")).filter(
        F.col("rule").isNotNull()
    )
    return union_all([by_value, too_many, by_qual])


def split_valid(values: DataFrame, violations: DataFrame) -> DataFrame:
    """Values of the records that break no rule."""
    return values.join(violations.select("key").distinct(), "key", "left_anti")


# --- comparing -----------------------------------------------------------------------------


_LANES = ("_h0", "_h1", "_h2", "_h3")


def record_fingerprints(values: DataFrame) -> DataFrame:
    """``(key, n, _h0 .. _h3)``: the number of values of a record and the sums of the four 32-bit parts
    of their MD5, which do not depend on the order of the rows. Sums meet before the shuffle, so a
    record of any size sends one row from each task. Parts cannot overflow below 2^31 values.
    """
    digest = F.md5(F.to_json(F.struct("attr", "pos", *VALUE_COLUMNS), {"ignoreNullFields": "false"}))
    parts = values.select("key", digest.alias("_d")).select(
        "key", *[F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("bigint").alias(h) for i, h in enumerate(_LANES)]
    )
    return parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in _LANES])


def records_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(key, equal)`` over the keys of both, from fingerprints alone: one row for each record meets.

    Equal records have equal fingerprints; different ones share one with a chance of 2^-128.
    """
    columns = ("n", *_LANES)
    left = record_fingerprints(a).select("key", F.struct(*columns).alias("_a"))
    right = record_fingerprints(b).select("key", F.struct(*columns).alias("_b"))
    return left.join(right, "key", "full").select("key", F.col("_a").eqNullSafe(F.col("_b")).alias("equal"))


def _diff_values(a: DataFrame, b: DataFrame) -> DataFrame:
    body = F.struct(*VALUE_COLUMNS)
    left = a.select("key", "attr", "pos", body.alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select("key", "attr", "pos", body.alias("_b"), F.lit(True).alias("_in_b"))
    change = (
        F.when(F.col("_in_a").isNull(), "added")
        .when(F.col("_in_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    both = left.join(right, ["key", "attr", "pos"], "full").withColumn("change", change)
    return both.filter(F.col("change").isNotNull()).select("key", "attr", "pos", "change")


def diff_records(a: DataFrame, b: DataFrame, few: int = 1_000_000) -> DataFrame:
    """``(key, attr, pos, change)`` for every value that differs, qualifiers included.

    Records whose fingerprints agree are left out first. Up to ``few`` differing keys (8 MB) go to
    the tasks, so that only values of differing records are shuffled. More differing keys
    than that are no small part of the work, and values meet directly.
    """
    differing = cut(records_equal(a, b).filter(~F.col("equal")).select("key"))
    if differing.count() > few:
        return _diff_values(a, b)
    only = F.broadcast(differing)
    return _diff_values(a.join(only, "key", "left_semi"), b.join(only, "key", "left_semi"))


def exact_copies(values: DataFrame, field: str) -> DataFrame:
    """Records per distinct first value of a field, for those held more than once. The text is
    hashed first, so that the shuffle carries digests."""
    first = values.filter((F.col("attr") == field) & (F.col("pos") == 0))
    digest = F.sha2(payload_text(), 256)
    return (
        first.select(digest.alias("digest"), "key")
        .groupBy("digest")
        .agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


# --- building records from a feed ----------------------------------------------------------


def fold_fields(feed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Builds records from an ordered feed of ``(key, seq, field, type, payload...)``.

    ``a`` appends a value to field a. ``a.b`` is qualifier b of the last a so far, or of the
    first one when it comes before any. NULL payloads are dropped. Returns values, qualifiers
    ``(key, attr, pos, qual, qpos, ...)``, and violations for qualifiers whose value never came.
    """
    payload = [c for c in feed.columns if c not in ("key", "seq", "field")]
    main = F.split_part("field", F.lit("."), F.lit(1))
    sub = F.split_part("field", F.lit("."), F.lit(2))
    present = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in payload if c != "type"], F.lit(False))
    rows = feed.filter(present)
    rows = rows.select("*", main.alias("attr"), F.when(sub != "", sub).alias("qual"))
    placed = scan.run(
        scan.place(rows, ["key", "attr", "seq"]),
        ["key", "attr"],
        {"_seen": ("count", F.when(F.col("qual").isNull(), F.lit(1)))},
    )
    rows = scan.unplace(placed).withColumn("pos", (F.greatest(F.col("_seen"), F.lit(1)) - 1).cast("int"))
    values = rows.filter(F.col("qual").isNull()).select("key", "attr", "pos", *payload)
    ranked = scan.rank(rows.filter(F.col("qual").isNotNull()), ["key", "attr", "pos", "qual"], ["seq"], "_r")
    quals = ranked.select("key", "attr", "pos", "qual", (F.col("_r") - 1).cast("int").alias("qpos"), *payload)
    orphans = quals.join(values.select("key", "attr", "pos"), ["key", "attr", "pos"], "left_anti")
    violations = orphans.select(
        "key", "attr", "pos", F.lit("incomplete").alias("rule"), F.col("qual").alias("detail")
    )
    return values, quals, violations


# --- removing entries by citation key ------------------------------------------------------


def purge(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Entries of a file ``(seq, citation_key, ...)`` without the given keys, order untouched."""
    return entries.join(cited.select("citation_key").distinct(), "citation_key", "left_anti")


# --- storing -------------------------------------------------------------------------------

# Every save is a folder of its own, complete before a row is added to the table that names the
# versions. Nothing is renamed, so there is a whole database at any moment on any file system.

_VERSIONS = "seq bigint, version string"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The versions that are kept, the latest first: two rows at most."""
    folder, fs = _folder(spark, f"{path}/current")
    if not fs.exists(folder):
        return []
    rows = spark.read.schema(_VERSIONS).parquet(f"{path}/current").orderBy(F.desc("seq")).limit(2).collect()
    return [(r.seq, r.version) for r in rows]


def create(path: str, values: DataFrame, schema: Schema, items: DataFrame, header: str = "", **more: DataFrame) -> None:
    """Stores a new database; an existing one is refused. ``more`` are further tables that belong
    to it: ``member`` and ``meta`` of its result sets, ``index``."""
    if _versions(values.sparkSession, path):
        raise FileExistsError(f"there is a database in {path}")
    save(path, values, schema, items, header, **more)


def save(path: str, values: DataFrame, schema: Schema, items: DataFrame, header: str = "", **more: DataFrame) -> None:
    """Stores a database again. The version before stays, so ``values`` may be read from it, and
    ``open_tables(..., back=1)`` opens it; older ones go."""
    spark = values.sparkSession
    kept = _versions(spark, path)
    version = uuid.uuid4().hex
    place = f"{path}/versions/{version}"
    values.select(*KEYED_COLUMNS).write.parquet(f"{place}/values")
    schema.attr_table(spark).write.parquet(f"{place}/schema_attr")
    schema.qual_table(spark).write.parquet(f"{place}/schema_qual")
    items.write.parquet(f"{place}/txo_item")
    spark.createDataFrame([(header,)], "header string").write.parquet(f"{place}/header")
    for name, table in more.items():
        table.write.parquet(f"{place}/{name}")
    seq = kept[0][0] + 1 if kept else 1
    spark.createDataFrame([(seq, version)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/current")
    for _, old in kept[1:]:
        folder, fs = _folder(spark, f"{path}/versions/{old}")
        fs.delete(folder, True)


def open_tables(spark: SparkSession, path: str, back: int = 0) -> dict[str, DataFrame]:
    """The tables of a stored database, or of the version before with ``back=1``; fails when
    there is none."""
    kept = _versions(spark, path)
    if len(kept) <= back:
        raise FileNotFoundError(f"no database in {path}")
    place = f"{path}/versions/{kept[back][1]}"
    folder, fs = _folder(spark, place)
    names = sorted(status.getPath().getName() for status in fs.listStatus(folder))
    return {name: spark.read.parquet(f"{place}/{name}") for name in names}


def destroy_tables(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def listed(values: DataFrame | None, index: DataFrame, member: DataFrame) -> DataFrame:
    """All rows of a database in one list: ``(part, key, detail)``."""
    row = lambda df, part, detail: df.select(F.lit(part).alias("part"), "key", F.col(detail).cast("string").alias("detail"))
    rows = row(index, "index", "term").union(row(member, "member", "rs_id"))
    return rows if values is None else rows.union(row(values, "values", "text"))
