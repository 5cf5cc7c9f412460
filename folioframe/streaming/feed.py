"""A feed of record changes, applied in batch or as a stream.

A change is ``(key, seq, op, payload)`` with op add, update or delete. An add needs a free
key, an update or delete an existing one; other changes are violations and have no effect.
State is ``(key, live, payload, seq)``. Deleted keys stay as rows with ``live = false``:
their ``seq`` makes a replayed change void.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as index_ops
from ..operators import postings, sets
from ..plans import scan
from ..session import cut

OPS = ("add", "update", "delete")
BUCKETS = 64
# Numbers of index segments between two batches, for ``postings.compact``.
SEGMENT_STEP = 1000


def empty_state(changes: DataFrame) -> DataFrame:
    return changes.select(
        "key", F.lit(True).alias("live"), F.col("payload"), F.col("seq")
    ).limit(0)


def judge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes newer than the state of their key, with ``valid``.

    Whether a key exists before a change is told by the last add or delete before it, valid
    or not: after an add the key exists in either case, after a delete it does not. So one
    running value per key decides all changes, however many a key has.
    """
    held = state.select("key", F.col("live").alias("_live"), F.col("seq").alias("_seq"))
    fresh = changes.join(held, "key", "left").filter(
        F.col("_seq").isNull() | (F.col("seq") > F.col("_seq"))
    )
    rows = scan.place(fresh.drop("_seq"), ["key", "seq"])
    moves = F.when(F.col("op").isin("add", "delete"), F.col("op"))
    rows = scan.unplace(scan.run(rows, ["key"], {"_move": ("last", moves)}, inclusive=False))
    exists = F.coalesce(F.col("_move") == "add", F.col("_live"), F.lit(False))
    valid = F.when(F.col("op") == "add", ~exists).when(F.col("op").isin("update", "delete"), exists).otherwise(False)
    return rows.withColumn("valid", valid).drop("_move", "_live")


def apply_changes(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after the changes, and the violations ``(key, seq, op)``."""
    judged = judge(state, changes)
    return next_state(state, judged), judged.filter(~F.col("valid")).select("key", "seq", "op")


def next_state(state: DataFrame, judged: DataFrame) -> DataFrame:
    # The order is the sequence number alone; a payload is never compared.
    last = F.max_by(F.struct("seq", "op", "payload"), "seq")
    news = judged.filter("valid").groupBy("key").agg(last.alias("_l")).select(
        "key",
        (F.col("_l.op") != "delete").alias("live"),
        F.when(F.col("_l.op") != "delete", F.col("_l.payload")).alias("payload"),
        F.col("_l.seq").alias("seq"),
    )
    kept = state.join(news.select("key"), "key", "left_anti")
    return kept.select("key", "live", "payload", "seq").unionByName(news)


def records(state: DataFrame) -> DataFrame:
    return state.filter("live").select("key", "payload")


def refresh(index: DataFrame, member: DataFrame, judged: DataFrame, values: DataFrame):
    """Index and sets after a batch: ``values`` are the values of the live records."""
    changed = judged.filter("valid").select("key").distinct()
    gone = changed.join(values.select("key").distinct(), "key", "left_anti")
    return index_ops.update(index, changed, sets.members(values, changed)), sets.cascade(member, gone)


def of_members(changes: DataFrame, member: DataFrame, rs_id: int) -> DataFrame:
    """The changes that concern members of one set; works on streams, too."""
    return changes.join(sets.select(member, rs_id).distinct(), "key", "left_semi")


# --- the stream -----------------------------------------------------------------------------


class StateTable:
    """State in a folder, by key bucket. A batch rewrites the buckets it touches.

    Batch n writes ``data/batch=n/bucket=b`` and then ``manifest/batch=n``, the batch that
    holds each bucket. A batch that failed half-way left no manifest, and is written again
    from the manifest before it: the outcome is the same as if it ran once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = f"{schema}, bucket int, batch bigint"

    def _batches(self) -> set[int]:
        """Finished batches, from the folder listing."""
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/batch=*/_SUCCESS")
        found = folder.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(folder)
        return {int(f.getPath().getParent().getName().split("=")[1]) for f in found or []}

    def _placement(self, before: int | None = None) -> dict[int, int]:
        """Bucket to batch; one row per bucket, so it fits on the driver."""
        done = [n for n in self._batches() if before is None or n < before]
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, held bigint").parquet(f"{self.path}/manifest/batch={max(done)}")
        return {r.bucket: r.held for r in rows.collect()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The state; with ``buckets`` only those, which prunes the folders that are read."""
        placement = self._placement(before)
        wanted = {b: n for b, n in placement.items() if buckets is None or b in set(buckets)}
        if not wanted:
            return self.spark.createDataFrame([], self.schema).drop("bucket", "batch")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data")
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in wanted.items():
            by_batch.setdefault(batch, []).append(bucket)
        held = F.lit(False)
        for batch, those in by_batch.items():
            held = held | ((F.col("batch") == batch) & F.col("bucket").isin(those))
        return rows.filter(held).drop("bucket", "batch")

    def bucket_of(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch, for ``foreachBatch``."""
        if batch in self._batches():
            return
        changes = cut(changes.select("key", "seq", "op", "payload"))
        touched = [r.b for r in changes.select(self.bucket_of().alias("b")).distinct().collect()]
        if not touched:
            return
        state, violations = apply_changes(self.read(touched, before=batch), changes)
        (
            state.withColumn("bucket", self.bucket_of())
            .repartition("bucket", F.pmod(F.xxhash64("seq"), F.lit(8)))
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.path}/data/batch={batch}")
        )
        violations.write.mode("overwrite").parquet(f"{self.path}/violations/batch={batch}")
        placement = self._placement(before=batch) | {b: batch for b in touched}
        rows = self.spark.createDataFrame(list(placement.items()), "bucket int, held bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")


    def vacuum(self) -> None:
        """Deletes the data of batches that no bucket is read from any more. Not while a batch
        is running: one that failed is written again from the state before it."""
        done = self._batches()
        used = set(self._placement().values())
        sc = self.spark.sparkContext
        for batch in done - used - {max(done, default=None)}:
            folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch={batch}")
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def follow(changes: DataFrame, table: StateTable, checkpoint: str):
    """Starts the stream that keeps ``table`` current; one pass over what is there."""
    return (
        changes.writeStream.foreachBatch(table.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_segment(state: DataFrame, changes: DataFrame, make_values, member: DataFrame | None = None) -> DataFrame:
    """Postings of the records that ``changes`` name, as ``state`` holds them after the changes.

    Keys without any state, whose changes were all invalid, keep what earlier segments say. A
    deleted record leaves the index and all sets; one that stays keeps the sets of ``member``.
    """
    touched = cut(state.join(changes.select("key").distinct(), "key", "left_semi"))
    present = records(touched)
    values = make_values(present)
    parts = [postings.word_rows(values), postings.field_rows(values), postings.key_rows(present)]
    if member is not None:
        parts.append(postings.set_rows(member.join(present.select("key"), "key", "left_semi")))
    return postings.change(touched.select("key"), *parts)


def follow_index(
    changes: DataFrame, table: StateTable, index: str, make_values: Callable[[DataFrame], DataFrame], checkpoint: str,
    members: Callable[[], DataFrame] | None = None,
):
    """Starts the stream that keeps ``table`` and the postings at ``index`` current; one pass over what is there.

    A batch writes one segment, of the size of its changes. A batch that is delivered again finds the
    state of its own time and writes the same segment anew, so it has no effect. ``make_values``
    makes long values of live records ``(key, payload)``; ``members`` gives the sets, at each batch.
    """

    def one(rows: DataFrame, batch: int) -> None:
        rows = cut(rows.select("key", "seq", "op", "payload"))
        buckets = [r.b for r in rows.select(table.bucket_of().alias("b")).distinct().collect()]
        if not buckets:
            return
        table.apply(rows, batch)
        state = table.read(buckets, before=batch + 1)
        segment = index_segment(state, rows, make_values, members() if members else None)
        postings.write(segment, index, segment=(batch + 1) * SEGMENT_STEP)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notify(changes: DataFrame, members: Callable[[], DataFrame], rs_id: int, path: str, checkpoint: str):
    """Starts the stream that writes the changes of one set's members to ``path/batch=n``; one pass over what is there.

    ``members`` is asked for the sets at each batch, so a set that grows or shrinks meanwhile is followed.
    A batch that is delivered again replaces its own folder.
    """

    def one(rows: DataFrame, batch: int) -> None:
        of_members(rows, members(), rs_id).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
