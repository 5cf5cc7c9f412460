"""The record model: typed multi-valued attributes, schema metadata, nested and long form.

Long form ``values``: one row per value, ``(key, attr, pos, type, text, person, date, txo,
quals)``. Nested form ``records``: ``(key, attrs MAP<STRING, ARRAY<value>>)``. Long form is
the base of all operators that combine values across rows, because no record has to be
gathered in one place for them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("text", "person", "date", "url", "id", "txo")

PERSON = "struct<honorific:string,first:string,last:string,lineage:string>"
DATE = "struct<year:int,month:int,day:int>"
TXO = "struct<grp:string,id:int>"
QUAL = f"struct<name:string,pos:int,type:string,text:string,person:{PERSON},date:{DATE},txo:{TXO}>"
VALUE = f"struct<type:string,text:string,person:{PERSON},date:{DATE},txo:{TXO},quals:array<{QUAL}>>"
VALUES = (
    f"key bigint, attr string, pos int, type string, text string, person {PERSON}, "
    f"date {DATE}, txo {TXO}, quals array<{QUAL}>"
)
VALUE_COLUMNS = ("type", "text", "person", "date", "txo", "quals")
KEYED_COLUMNS = ("key", "attr", "pos", *VALUE_COLUMNS)

VIOLATIONS = "key bigint, attr string, pos int, rule string, detail string"


class SchemaError(ValueError):
    """The schema itself is wrong."""


@dataclass(frozen=True)
class Qualifier:
    type: str
    grp: str | None = None
    names: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Attribute:
    type: str
    grp: str | None = None
    max_n: int | None = None
    indexed: bool = False
    names: dict = field(default_factory=dict)
    quals: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Schema:
    """Attribute definitions. This is metadata of a database, and stays on the driver."""

    id: str
    attrs: dict

    def __post_init__(self):
        for name, attr in self.attrs.items():
            for where, kind in [(name, attr.type)] + [
                (f"{name}.{q}", qual.type) for q, qual in attr.quals.items()
            ]:
                if kind not in TYPES:
                    raise SchemaError(f"{where}: unknown type {kind!r}")

    def attr_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.id, n, a.type, a.grp, a.max_n, a.indexed, dict(a.names))
            for n, a in self.attrs.items()
        ]
        return spark.createDataFrame(
            rows,
            "schema_id string, attr string, type string, grp string, max_n int, "
            "indexed boolean, names map<string,string>",
        )

    def qual_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.id, n, q, d.type, d.grp, dict(d.names))
            for n, a in self.attrs.items()
            for q, d in a.quals.items()
        ]
        return spark.createDataFrame(
            rows,
            "schema_id string, attr string, qual string, type string, grp string, "
            "names map<string,string>",
        )


# --- value constructors: every one yields the same struct type ---------------------------


def person(last, first=None, honorific=None, lineage=None) -> Column:
    parts = {"honorific": honorific, "first": first, "last": last, "lineage": lineage}
    return F.struct(
        *[(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in parts.items()]
    ).cast(PERSON)


def partial_date(year, month=None, day=None) -> Column:
    parts = {"year": year, "month": month, "day": day}
    return F.struct(
        *[(F.lit(None) if c is None else c).cast("int").alias(n) for n, c in parts.items()]
    ).cast(DATE)


def txo(grp: str, id_: Column) -> Column:
    return F.struct(F.lit(grp).alias("grp"), id_.cast("int").alias("id")).cast(TXO)


def _payload(kind: str, value: Column) -> dict[str, Column]:
    slot = {"person": "person", "date": "date", "txo": "txo"}.get(kind, "text")
    types = {"text": "string", "person": PERSON, "date": DATE, "txo": TXO}
    return {
        name: value.cast(t) if name == slot else F.lit(None).cast(t) for name, t in types.items()
    }


def value(kind: str, payload: Column, quals: Column | None = None) -> Column:
    """A value struct; NULL when the payload is NULL, so that absent values vanish."""
    quals = F.array() if quals is None else quals
    body = F.struct(
        F.lit(kind).alias("type"),
        *[c.alias(n) for n, c in _payload(kind, payload).items()],
        quals.cast(f"array<{QUAL}>").alias("quals"),
    ).cast(VALUE)
    return F.when(payload.isNotNull(), body)


def qual(name: str, kind: str, payload: Column, pos: int = 0) -> Column:
    """A qualifier struct; NULL when the payload is NULL."""
    body = F.struct(
        F.lit(name).alias("name"),
        F.lit(pos).alias("pos"),
        F.lit(kind).alias("type"),
        *[c.alias(n) for n, c in _payload(kind, payload).items()],
    ).cast(QUAL)
    return F.when(payload.isNotNull(), body)


def quals(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def one(v: Column) -> Column:
    """A single optional value as the list of an attribute."""
    return F.array_compact(F.array(v))


def attributes(**fields: Column) -> Column:
    """The ``attrs`` map; attributes without values are left out."""
    pairs = []
    for name, values in fields.items():
        pairs += [F.lit(name), values.cast(f"array<{VALUE}>")]
    return F.map_filter(F.create_map(*pairs), lambda _, vs: F.size(vs) > 0)


# --- between the forms -------------------------------------------------------------------


def to_values(records: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Nested to long form, without a shuffle.

    The outer explode is on purpose: for the inner one Spark adds a test of the size of the
    list below it, which computes the list a second time.
    """
    lists = records.select("key", F.explode_outer(attrs).alias("attr", "_values"))
    rows = lists.select("key", "attr", F.posexplode_outer("_values").alias("pos", "_value"))
    rows = rows.filter(F.col("pos").isNotNull())
    return rows.select("key", "attr", "pos", *[F.col(f"_value.{c}").alias(c) for c in VALUE_COLUMNS])


def values_of(df: DataFrame, key: Column, attr: str | Column, pos: Column, kind: str, payload: Column,
              quals_: Column | None = None, present: Column | None = None) -> DataFrame:
    """Long rows of an attribute, straight from the columns of any table. ``present`` is a
    cheap test that the payload is there; by default the payload itself is tested."""
    if present is not None:
        df = df.filter(present)
    v = value(kind, payload, quals_)
    name = F.lit(attr) if isinstance(attr, str) else attr
    rows = df.select(
        key.cast("bigint").alias("key"), name.alias("attr"), pos.cast("int").alias("pos"), v.alias("_v")
    )
    if present is None:
        rows = rows.filter(F.col("_v").isNotNull())
    return rows.select("key", "attr", "pos", *[F.col(f"_v.{c}").alias(c) for c in VALUE_COLUMNS])


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def payload_text(row: str = "") -> Column:
    """A value as one line of text, for reports and comparisons."""
    c = lambda n: F.col(f"{row}.{n}" if row else n)
    part = lambda s, n: F.coalesce(c(f"{s}.{n}").cast("string"), F.lit(""))
    return (
        F.when(c("type").isin("text", "url", "id"), c("text"))
        .when(c("type") == "person", F.concat_ws("|", *[part("person", n) for n in ("honorific", "first", "last", "lineage")]))
        .when(c("type") == "date", F.concat_ws("-", *[part("date", n) for n in ("year", "month", "day")]))
        .when(c("type") == "txo", F.concat_ws("/", c("txo.grp"), c("txo.id").cast("string")))
    )


def get_field(name: str) -> Column:
    """All values of a field, or of a qualifier of its first value (``a.b``); NULL if absent."""
    main, _, sub = name.partition(".")
    values = F.try_element_at(F.col("attrs"), F.lit(main))
    if not sub:
        return values
    first = F.try_element_at(values, F.lit(1))
    found = F.filter(first["quals"], lambda q: q["name"] == sub)
    return F.when(F.size(found) > 0, F.array_sort(found, lambda a, b: a["pos"] - b["pos"]))


def one_value(name: str) -> Column:
    """The first value of a field or qualifier, NULL if absent."""
    return F.try_element_at(get_field(name), F.lit(1))


def record_key() -> Column:
    return F.col("key").cast("string")


def localized(names: Column, language: str) -> Column:
    """A name in ``language`` (``en_US``): exact, language without country, ``''``, ``C``."""
    order = [language, language.split("_")[0], "", "C"]
    seen = list(dict.fromkeys(order))
    return F.coalesce(*[F.try_element_at(names, F.lit(k)) for k in seen])
