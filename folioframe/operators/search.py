"""Boolean retrieval.

Every condition is a Column, so a whole tree of and / or / not is one expression that
Catalyst plans. There are two settings for it:

* over ``values`` (long form) a condition is an aggregate of the rows of one record:
  ``match_values(values, any_word("x") & ~has_field("y"))`` is one scan and one shuffle of
  flags, whatever the size of the tree or of a record;
* over ``records`` (nested form) it is a filter: one scan, no shuffle. Use the functions of
  ``nested`` for it.

``any_word`` sees top-level values only, never qualifiers.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import ROW, has_word, value_has_word, value_terms
from ..model import Schema


class InvalidQuery(ValueError):
    """A query names a field the schema does not have, or of the wrong type."""


def check_field(schema: Schema | None, name: str, kind: str | None = None) -> None:
    if schema is None:
        return
    attr = schema.attrs.get(name)
    if attr is None:
        raise InvalidQuery(f"unknown field {name!r}")
    if kind is not None and attr.type != kind:
        raise InvalidQuery(f"field {name!r} is {attr.type}, not {kind}")


def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


# --- conditions over the long form --------------------------------------------------------


def any_word(word: str, url_lower: bool = False) -> Column:
    return _any(value_has_word(ROW, word, url_lower))


def has_field(name: str, schema: Schema | None = None) -> Column:
    check_field(schema, name)
    return _any(F.col("attr") == name)


def in_taxonomy(name: str, grp: str, item: int, schema: Schema | None = None) -> Column:
    """Needs ``path`` on the values, see ``taxonomy.with_paths``."""
    check_field(schema, name, "txo")
    return _any(
        (F.col("attr") == name) & (F.col("txo.grp") == grp) & F.array_contains("path", F.lit(item))
    )


def in_subtree(name: str, bounds: tuple[int, int], schema: Schema | None = None) -> Column:
    """The same by the range of places of a subtree. Needs ``place`` on the values, see
    ``taxonomy.with_places`` and ``taxonomy.bounds``."""
    check_field(schema, name, "txo")
    return _any((F.col("attr") == name) & F.col("place").between(*bounds))


def null() -> Column:
    """Matches everything; the neutral element of a conjunction."""
    return F.lit(True)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction; ``None`` is the neutral element on either side."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True)) if given else null()


def any_of(*conditions: Column | None) -> Column:
    """Disjunction; ``None`` is the neutral element on either side."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, given) if given else null()


def match_values(values: DataFrame, condition: Column, keys: DataFrame | None = None) -> DataFrame:
    """Keys of the matching records.

    ``keys`` lists all records of the database. It is needed when the condition can hold for
    a record without any value (a negation), and then adds one flagless row per record.
    """
    if keys is not None:
        values = values.unionByName(keys.select("key"), allowMissingColumns=True)
    return values.groupBy("key").agg(condition.alias("_hit")).filter("_hit").select("key")


# --- conditions over the nested form ------------------------------------------------------


def _nested_any_word(word: str, url_lower: bool = False) -> Column:
    values = F.flatten(F.map_values("attrs"))
    return F.exists(values, lambda v: value_has_word(v, word, url_lower))


def _nested_has_field(name: str, schema: Schema | None = None) -> Column:
    check_field(schema, name)
    return F.map_contains_key("attrs", name)


def _nested_in_taxonomy(name: str, grp: str, ids: list[int], schema: Schema | None = None) -> Column:
    """``ids`` is the subtree of the item where that is schema metadata, a short fixed list. A
    taxonomy that is a table is searched in long form, by a join."""
    check_field(schema, name, "txo")
    values = F.try_element_at("attrs", F.lit(name))
    hit = F.exists(values, lambda v: (v["txo"]["grp"] == grp) & v["txo"]["id"].isin(ids))
    return F.coalesce(hit, F.lit(False))


def _stored_any_word(word: str) -> Column:
    """The same as ``any_word`` over records that carry their terms."""
    return F.array_contains("terms", word.lower())


def _stored_has_field(name: str, schema: Schema | None = None) -> Column:
    check_field(schema, name)
    return F.array_contains("attr_names", name)


nested = SimpleNamespace(
    any_word=_nested_any_word, has_field=_nested_has_field, in_taxonomy=_nested_in_taxonomy, null=null
)
stored = SimpleNamespace(any_word=_stored_any_word, has_field=_stored_has_field, null=null)


# --- conditions over source columns ---------------------------------------------------------
# Where a field is one column of the source, a condition on it is one on the column: the scan
# can push it down, and rows that fail it are never searched for words.


def column_any_word(word: str, *texts: Column) -> Column:
    return reduce(lambda a, b: a | b, [has_word(t, word) for t in texts])


columns = SimpleNamespace(any_word=column_any_word)


def searchable(records: DataFrame) -> DataFrame:
    """Records with ``terms`` and ``attr_names`` as columns of their own, to be stored: a
    search then reads these and never the text."""
    terms = F.flatten(F.transform(F.flatten(F.map_values("attrs")), lambda v: value_terms(v)))
    return records.withColumn("terms", F.array_distinct(terms)).withColumn("attr_names", F.map_keys("attrs"))


def match(records: DataFrame, condition: Column) -> DataFrame:
    return records.filter(condition).select("key")


def count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("n"))


def has_keys(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of the wanted keys exist."""
    held = records.select("key", F.lit(True).alias("_held"))
    return wanted.select("key").distinct().join(held, "key", "left").select(
        "key", F.coalesce("_held", F.lit(False)).alias("present")
    )
