"""Stored postings as bitmaps, and boolean queries that read nothing else.

A posting row holds, for one term and one bucket of 2**15 keys, the 64-bit words of its bitmap that
are not zero: one word for a rare term, 512 for a term of every record. Terms are of a ``kind``: a
``word``, a ``field`` that a record has, an ``item`` of a taxonomy field (with its place in the tree as
``at``), a result ``set``, and ``all`` for the keys themselves. Rows are sorted by term over all files, so a
query reads the row groups of its own terms, and a frequent term fills as many files as it needs.

A condition is made of two Columns: which postings it reads, and the word of hits it makes of
them. ``&``, ``|`` and ``~`` combine both, so a tree of any size is one scan, one shuffle by word number
and bit operations on longs. ``~`` is taken against the keys of the same words.

Changes go into segments: the postings of the changed records, with the changed and deleted keys under
the kind ``dead``. A segment costs as much as its change. A query takes segments in order, and the
dead keys of a later one out of those before it. ``compact`` joins the last segments into one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import ROW, value_terms
from ..model import Schema
from ..session import drop_tables
from .search import check_field

WORD_BITS = 6  # 64 keys in a word
BUCKET_BITS = 15  # keys of a bucket
SCHEMA = "kind string, name string, at bigint, bucket bigint, words array<struct<word:int,bits:bigint>>"
_TERM = ["kind", "name", "at"]
_BY_NAME = ["name", "kind", "at"]  # to group by: nearly all rows are of one kind, so names tell them apart first
Rows = DataFrame  # (kind, name, at, key)


# --- from records to postings ---------------------------------------------------------------


def _rows(df: DataFrame, kind: str, name: Column, at: Column | None = None) -> Rows:
    at = F.lit(None) if at is None else at
    return df.select(F.lit(kind).alias("kind"), name.alias("name"), at.cast("bigint").alias("at"), F.col("key").cast("bigint").alias("key"))


def key_rows(keys: DataFrame) -> Rows:
    """All records, for ``~`` and the empty condition."""
    return _rows(keys, "all", F.lit(""))


def dead_rows(keys: DataFrame) -> Rows:
    """Keys whose earlier postings no longer hold."""
    return _rows(keys, "dead", F.lit(""))


def set_rows(members: DataFrame) -> Rows:
    """Result sets ``(rs_id, key)``."""
    return _rows(members, "set", F.col("rs_id").cast("string"))


def word_rows(values: DataFrame, url_lower: bool = False) -> Rows:
    """Words of top-level values."""
    terms = F.explode(F.array_distinct(value_terms(ROW, url_lower)))
    return _rows(values.select("key", terms.alias("term")), "word", F.col("term"))


def nested_word_rows(records: DataFrame) -> Rows:
    terms = F.flatten(F.transform(F.flatten(F.map_values("attrs")), lambda v: value_terms(v)))
    return _rows(records.select("key", F.explode(F.array_distinct(terms)).alias("term")), "word", F.col("term"))


def field_rows(values: DataFrame) -> Rows:
    return _rows(values, "field", F.col("attr"))


def nested_field_rows(records: DataFrame) -> Rows:
    return _rows(records.select("key", F.explode(F.map_keys("attrs")).alias("attr")), "field", F.col("attr"))


def item_rows(values: DataFrame) -> Rows:
    """Taxonomy values with their ``place``, see ``taxonomy.with_places``."""
    items = values.filter(F.col("place").isNotNull())
    return _rows(items, "item", F.concat_ws(" ", "attr", "txo.grp"), F.col("place"))


def build(*parts: Rows) -> DataFrame:
    """Postings of ``parts``. Keys of a word are combined before the shuffle; a row has 512 words at most."""
    rows = reduce(DataFrame.unionByName, parts)
    words = rows.groupBy(
        *_BY_NAME,
        F.shiftright("key", BUCKET_BITS).alias("bucket"),
        F.shiftright("key", WORD_BITS).bitwiseAND(F.lit((1 << BUCKET_BITS - WORD_BITS) - 1)).cast("int").alias("word"),
    ).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(key & {(1 << WORD_BITS) - 1} AS INT))")).alias("bits"))
    return _gather(words)


def _gather(words: DataFrame) -> DataFrame:
    gathered = F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    return words.groupBy(*_BY_NAME, "bucket").agg(gathered).select(*_TERM, "bucket", "words")


# --- segments -------------------------------------------------------------------------------


def write(postings: DataFrame, path: str, segment: int = 0) -> None:
    """Writes a segment, or writes it anew: a change that is delivered twice is stored once."""
    order = [*_TERM, "bucket"]
    sorted_rows = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode("overwrite").parquet(f"{path}/segment={segment}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, segment int").option("basePath", path).parquet(path)


def segments(postings: DataFrame) -> list[int]:
    """The numbers of the segments; few, as ``compact`` joins them."""
    return [r.segment for r in postings.select("segment").distinct().sort("segment").collect()]


def change(changed: DataFrame, *parts: Rows) -> DataFrame:
    """Postings of a segment: ``changed`` keys go out of all earlier ones, ``parts`` come in. A
    record that stays has to be in ``parts`` with all its rows, its key row included."""
    return build(dead_rows(changed.select("key").distinct()), *parts)


def _words(postings: DataFrame) -> DataFrame:
    return postings.select("*", F.explode("words").alias("_w")).select(
        *[c for c in postings.columns if c != "words"], F.col("_w.word").alias("word"), F.col("_w.bits").alias("bits")
    )


def live(postings: DataFrame) -> DataFrame:
    """Words ``(kind, name, at, bucket, word, bits)`` of all segments as they hold now."""
    words = _words(postings)
    dead = words.filter("kind = 'dead'").groupBy("bucket", "word").agg(F.collect_list(F.struct("segment", "bits")).alias("dead"))
    later = F.aggregate(
        F.filter("dead", lambda d: d["segment"] > F.col("segment")), F.lit(0).cast("bigint"), lambda a, d: a.bitwiseOR(d["bits"])
    )
    held = words.filter("kind <> 'dead'").join(dead, ["bucket", "word"], "left")
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(later, F.lit(0).cast("bigint"))))
    held = held.select(*_TERM, "bucket", "word", bits.alias("bits")).filter("bits <> 0")
    return held.groupBy(*_TERM, "bucket", "word").agg(F.bit_or("bits").alias("bits"))


def compact(spark: SparkSession, path: str, first: int = 1) -> int:
    """Joins the segments from ``first`` on into a new last one; those before are not read. The dead
    keys stay, so a reader that still sees the joined segments finds the same records."""
    every = read(spark, path)
    numbers = [n for n in segments(every) if n >= first]
    some = every.filter(F.col("segment") >= first)
    dead = _words(some).filter("kind = 'dead'").groupBy(*_TERM, "bucket", "word").agg(F.bit_or("bits").alias("bits"))
    write(_gather(live(some).unionByName(dead)), path, numbers[-1] + 1)
    drop_tables(spark, [f"{path}/segment={n}" for n in numbers])
    return numbers[-1] + 1


def term_keys(postings: DataFrame) -> DataFrame:
    """``(term, key)`` of all words: the inverted index as it holds now."""
    words = live(postings.filter(F.col("kind").isin("word", "dead")))
    return _keys(words, F.col("name").alias("term"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Records per term, without a look at single keys."""
    words = live(postings.filter(F.col("kind").isin("word", "dead")))
    return words.groupBy(F.col("name").alias("term")).agg(F.sum(F.bit_count("bits").cast("bigint")).alias("n_records"))


# --- conditions -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """``reads``: the postings it needs. ``hits(leaf)``: 64 hits at a time, where ``leaf`` makes the
    aggregate for the rows of one leaf."""

    reads: Column
    hits: Callable[[Callable[[Column], Column]], Column]

    def __and__(self, other: Condition) -> Condition:
        return Condition(self.reads | other.reads, lambda leaf: self.hits(leaf).bitwiseAND(other.hits(leaf)))

    def __or__(self, other: Condition) -> Condition:
        return Condition(self.reads | other.reads, lambda leaf: self.hits(leaf).bitwiseOR(other.hits(leaf)))

    def __invert__(self) -> Condition:
        every = null()
        return Condition(
            self.reads | every.reads, lambda leaf: every.hits(leaf).bitwiseAND(F.bitwise_not(self.hits(leaf)))
        )


def _leaf(rows: Column) -> Condition:
    return Condition(rows, lambda leaf: leaf(rows))


def _of(kind: str, name: str) -> Column:
    return (F.col("kind") == kind) & (F.col("name") == name)


def null() -> Condition:
    """Every record; the neutral element of a conjunction."""
    return _leaf(F.col("kind") == "all")


def any_word(word: str) -> Condition:
    return _leaf(_of("word", word.lower()))


def has_field(name: str, schema: Schema | None = None) -> Condition:
    check_field(schema, name)
    return _leaf(_of("field", name))


def in_taxonomy(name: str, grp: str, bounds: tuple[int, int], schema: Schema | None = None) -> Condition:
    """``bounds`` are the first and last place of the subtree, see ``taxonomy.bounds``."""
    check_field(schema, name, "txo")
    return _leaf(_of("item", f"{name} {grp}") & F.col("at").between(*bounds))


def in_set(rs_id: int) -> Condition:
    """Members of a stored result set: unions, intersections and differences of sets are conditions."""
    return _leaf(_of("set", str(rs_id)))


def all_of(*conditions: Condition | None) -> Condition:
    """Conjunction; ``None`` is the neutral element on either side."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else null()


def any_of(*conditions: Condition | None) -> Condition:
    """Disjunction; ``None`` is the neutral element on either side."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, given) if given else null()


def hits(postings: DataFrame, condition: Condition) -> DataFrame:
    """``(bucket, word, bits)`` of the matching records."""
    numbers = segments(postings)
    is_dead = F.col("kind") == "dead"
    none = F.lit(0).cast("bigint")

    def some(rows: Column) -> Column:
        return F.coalesce(F.bit_or(F.when(rows, F.col("bits"))), none)

    def leaf(rows: Column) -> Column:
        found = none
        for number in numbers:
            here = F.col("segment") == number
            # The first segment has nothing before it.
            before = found.bitwiseAND(F.bitwise_not(some(is_dead & here))) if number != numbers[0] else found
            found = before.bitwiseOR(some(rows & here))
        return found

    reads = condition.reads | is_dead if len(numbers) > 1 else condition.reads
    words = _words(postings.filter(reads))
    return words.groupBy("bucket", "word").agg(condition.hits(leaf).alias("bits")).filter("bits <> 0")


def _keys(words: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and a row for each key of a word, as ``key``."""
    first = F.shiftleft("bucket", BUCKET_BITS) + F.shiftleft(F.col("word").cast("bigint"), WORD_BITS)
    places = F.explode(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1)))
    rows = words.select(*columns, first.alias("_first"), "bits", places.alias("_i"))
    # A filter on rows is compiled; one inside an array calls a function for each of its elements.
    set_ = rows.filter(F.bit_get("bits", F.col("_i")) == 1)
    return set_.withColumn("key", F.col("_first") + F.col("_i")).drop("_first", "bits", "_i")


def match(postings: DataFrame, condition: Condition) -> DataFrame:
    """Keys of the matching records."""
    return _keys(hits(postings, condition))


def count(postings: DataFrame, condition: Condition) -> DataFrame:
    """Number of matching records, from the bits."""
    found = hits(postings, condition)
    return found.agg(F.coalesce(F.sum(F.bit_count("bits").cast("bigint")), F.lit(0).cast("bigint")).alias("n"))
