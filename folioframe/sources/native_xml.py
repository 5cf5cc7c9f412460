"""The native XML format: schema, header, entries, result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PERSON, QUAL, TXO, VALUE, VALUE_COLUMNS, Attribute, Qualifier, Schema, SchemaError, partial_date, union_all
from ..operators.taxonomy import check_names
from ..plans import scan
from ..schemas import ITEMS
from ..session import cut
from .common import Ingest, file_place, malformed, read_xml, read_xml_document, violations

_OWN = {
    "person": "_honorific:string,_first:string,_last:string,_lineage:string",
    "date": "_year:int,_month:int,_day:int",
    "url": "_href:string",
    "id": "_value:string",
    "txo": "_group:string,_id:int",
    "text": "_VALUE:string,content:string",
}
_KINDS = ("text", "person", "date", "url", "id", "txo")


def _typed_lists(inner: str) -> str:
    return ",".join(f"{k}:array<struct<{_OWN[k]}{inner}>>" for k in _KINDS)


_QUALIFIERS = f",attribute:array<struct<_id:string,{_typed_lists('')}>>"
_ENTRY = f"_id bigint, attribute array<struct<_id:string,{_typed_lists(_QUALIFIERS)}>>"


def _payload(kind: str, x: Column) -> dict[str, Column]:
    """The payload columns of one element."""
    out = {n: F.lit(None).cast(t) for n, t in (("text", "string"), ("person", PERSON), ("txo", TXO))}
    out["date"] = F.lit(None).cast("struct<year:int,month:int,day:int>")
    if kind == "person":
        out["person"] = F.struct(*[x[f"_{p}"].alias(p) for p in ("honorific", "first", "last", "lineage")]).cast(PERSON)
    elif kind == "date":
        out["date"] = partial_date(x["_year"], x["_month"], x["_day"])
    elif kind == "txo":
        out["txo"] = F.struct(x["_group"].alias("grp"), x["_id"].alias("id")).cast(TXO)
    elif kind == "text":
        # An element without content is the empty text.
        out["text"] = F.coalesce(x["content"], x["_VALUE"], F.lit(""))
    else:
        out["text"] = x["_href" if kind == "url" else "_value"]
    return {n: out[n] for n in ("text", "person", "date", "txo")}


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _list(elements: Column, kind: str, make) -> Column:
    return F.coalesce(F.transform(elements, make), _none(kind))


def _qual_list(attr: Column, kind: str) -> Column:
    def make(q: Column, n: Column) -> Column:
        parts = [c.alias(p) for p, c in _payload(kind, q).items()]
        return F.struct(attr["_id"].alias("name"), n.alias("pos"), F.lit(kind).alias("type"), *parts).cast(QUAL)

    return _list(attr[kind], QUAL, make)


def _quals(x: Column) -> Column:
    lists = F.transform(x["attribute"], lambda attr: F.concat(*[_qual_list(attr, k) for k in _KINDS]))
    return F.coalesce(F.flatten(lists), _none(QUAL))


def _value_list(attr: Column, kind: str) -> Column:
    def make(x: Column) -> Column:
        parts = [c.alias(p) for p, c in _payload(kind, x).items()]
        return F.struct(F.lit(kind).alias("type"), *parts, _quals(x).alias("quals")).cast(VALUE)

    return _list(attr[kind], VALUE, make)


def _values(attr: Column) -> Column:
    return F.concat(*[_value_list(attr, k) for k in _KINDS])


def _field(attr: Column) -> Column:
    return F.struct(attr["_id"].alias("attr"), _values(attr).alias("vals"))


def ingest_native_xml(spark: SparkSession, path: str, schema: Schema | None = None, row_tag: str = "entry") -> Ingest:
    """Reads entries; keys are those of the file. With a schema, fields and qualifiers it does
    not know are violations."""
    rows = read_xml(spark, path, row_tag, _ENTRY)
    fields = F.filter(F.transform("attribute", _field), lambda f: f["attr"].isNotNull())
    # Parsed once: values and violations both start from here.
    rows = cut(rows.select(F.col("_id").alias("key"), fields.alias("fields"), "_malformed"))
    lists = rows.select("key", F.explode_outer("fields").alias("_f")).filter(F.col("_f").isNotNull())
    cells = lists.select("key", F.col("_f.attr").alias("attr"), F.posexplode_outer("_f.vals").alias("pos", "_v"))
    values = cells.filter(F.col("pos").isNotNull()).select(
        "key", "attr", "pos", *[F.col(f"_v.{c}").alias(c) for c in VALUE_COLUMNS]
    )
    wrong = [malformed(rows)]
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    wrong.append(violations(repeated, F.lit(None), "duplicate_key", F.col("n")))
    if schema is not None:
        unknown = lists.filter(~F.col("_f.attr").isin(list(schema.attrs)))
        wrong.append(violations(unknown, F.col("_f.attr"), "unknown_attribute", F.col("_f.attr")))
        pairs = [f"{n}.{q}" for n, a in schema.attrs.items() for q in a.quals]
        qualified = values.filter(F.col("attr").isin(list(schema.attrs))).select("key", "attr", "pos", F.explode("quals").alias("_q"))
        odd = qualified.filter(~F.concat_ws(".", "attr", "_q.name").isin(pairs))
        wrong.append(violations(odd, F.col("attr"), "unknown_qualifier", F.col("_q.name"), F.col("pos")))
    return Ingest(values, union_all(wrong), spark.createDataFrame([], "tag string, n bigint"))


_OPEN, _COMMENT, _CDATA = 0, 1, 2
_CHUNK = 256


def _after(move: Column, state: Column) -> Column:
    """The state that ``move`` leads to. A move is a map of the three states, as three digits to base 3."""
    three = F.when(state == _OPEN, 1).when(state == _COMMENT, 3).otherwise(9)
    return (F.floor(move / three) % 3).cast("int")


def _move() -> Column:
    """What a piece does: it may open a comment or a CDATA section at its start, and close either.
    Nothing opens inside the other, and a piece has no second start."""
    value = F.col("value")
    closes, ends = value.contains("-->"), value.contains("]]>")
    opened = F.when(value.startswith("!--") & ~closes, _COMMENT).when(value.startswith("![CDATA[") & ~ends, _CDATA)
    comment = F.when(closes, _OPEN).otherwise(_COMMENT)
    section = F.when(ends, _OPEN).otherwise(_CDATA)
    return F.coalesce(opened, F.lit(_OPEN)) + 3 * comment + 9 * section


def _states(moves: DataFrame) -> DataFrame:
    """``(n, state)`` after each move of ``(n, move)``, n from 0 without gaps.

    Maps compose in any grouping: each chunk is composed to one move, the chunks are solved the same
    way one level up, and their states go down again. No row holds more than a chunk.
    """
    by_chunk = moves.groupBy(F.expr(f"n div {_CHUNK}").alias("_chunk"))
    chunks = cut(by_chunk.agg(F.sort_array(F.collect_list(F.struct("n", "move"))).alias("_moves")))
    identity = _OPEN + 3 * _COMMENT + 9 * _CDATA
    start = F.lit(_OPEN)
    if chunks.count() > 1:
        def compose(f: Column, m: Column) -> Column:
            return sum(3**s * _after(m["move"], _after(f, F.lit(s))) for s in (_OPEN, _COMMENT, _CDATA)).cast("int")

        whole = chunks.select(F.col("_chunk").alias("n"), F.aggregate("_moves", F.lit(identity), compose).alias("move"))
        before = _states(whole).select((F.col("n") + 1).alias("_chunk"), F.col("state").alias("_start"))
        chunks = chunks.join(before, "_chunk", "left")
        start = F.coalesce("_start", F.lit(_OPEN))
    known = F.array().cast("array<int>")

    def step(found: Column, m: Column) -> Column:
        state = F.when(F.size(found) == 0, start).otherwise(F.element_at(found, F.greatest(F.size(found), F.lit(1))))
        return F.concat(found, F.array(_after(m["move"], state)))

    rows = chunks.select(F.arrays_zip("_moves", F.aggregate("_moves", known, step).alias("state")).alias("_z"))
    return rows.select(F.explode("_z").alias("_z")).select(F.col("_z._moves.n").alias("n"), F.col("_z.state").alias("state"))


def _tags(spark: SparkSession, path: str, names: str) -> DataFrame:
    """One row per tag of the given names, in file order: ``_file, _block, _mid, end, tag, value``.

    The text source cuts at ``<``, so it does not matter how the tags lie on lines. Tags inside
    comments and CDATA sections are no tags; either may span pieces and blocks of its file.
    """
    pieces = spark.read.option("lineSep", "<").text(path)
    pieces = pieces.select(*file_place(), F.monotonically_increasing_id().alias("_mid"), "value")
    name = F.regexp_extract("value", rf"^(/?)({names})(?=[\s/>])", 2)
    marker = F.col("value").startswith("!--") | F.col("value").startswith("![CDATA[")
    marker = marker | F.col("value").contains("-->") | F.col("value").contains("]]>")
    pieces = pieces.select(
        "_file", "_block", "_mid", F.col("value").startswith("/").alias("end"), name.alias("tag"), "value", marker.alias("_marker")
    )
    rows = cut(pieces.filter((F.col("tag") != "") | F.col("_marker")))
    marked = rows.filter("_marker")
    if marked.isEmpty():
        return rows.drop("_marker")
    # What one file leaves open ends with the file: its first piece, before any tag, closes all.
    first = rows.groupBy("_file").agg(F.lit(-1).cast("bigint").alias("_block"), F.lit(-1).cast("bigint").alias("_mid"), F.lit(0).alias("move"))
    moves = marked.select("_file", "_block", "_mid", _move().alias("move")).unionByName(first)
    moves = cut(scan.number(moves, ["_file", "_block", "_mid"], "n"))
    states = moves.join(_states(moves.select("n", "move")), "n").select("_file", "_block", "_mid", "state")
    every = rows.join(states, ["_file", "_block", "_mid"], "full")
    placed = scan.place(every, ["_file", "_block", "_mid"])
    inside = scan.unplace(scan.run(placed, [], {"_inside": ("last", F.col("state"))}, inclusive=False))
    return inside.filter((F.coalesce("_inside", F.lit(_OPEN)) == _OPEN) & (F.col("tag") != "")).select(
        "_file", "_block", "_mid", "end", "tag", "value"
    )


def _attribute(name: str) -> Column:
    """An XML attribute in quotes of either kind, NULL when there is none."""
    pattern = rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    text = F.concat(F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2))
    return F.when(F.col("value").rlike(pattern), _unescape(text))


# The entities that XML knows without a declaration: fixed values of the format.
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _unescape(text: Column) -> Column:
    """Character references, decimal or hexadecimal, and the entities of XML; others stay as they are."""
    pattern = r"^(#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6}|" + "|".join(_ENTITIES) + ");"

    def decode(part: Column) -> Column:
        name = F.regexp_extract(part, pattern, 1)
        digits = F.regexp_extract(name, r"^#x?(.*)$", 1)
        code = F.conv(digits, 16, 10).try_cast("int")
        code = F.when(name.startswith("#x"), code).otherwise(digits.try_cast("int"))
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        known = F.coalesce(F.when(valid, code), F.lit(32))
        mark = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32"))
        for entity, sign in _ENTITIES.items():
            mark = F.when(name == entity, F.lit(sign)).otherwise(mark)
        return F.coalesce(F.concat(mark, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def read_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rs_id, key)`` and ``(rs_id, name)``. A set may be larger than a row should be, so its
    tags are read, and each reference takes the set opened last before it."""
    rows = _tags(spark, path, "resultset|ref").filter(~F.col("end"))
    rows = rows.select(
        "_file", "_block", "_mid", "tag", _attribute("id").try_cast("bigint").alias("id"), _attribute("name").alias("name")
    )
    opened = F.when(F.col("tag") == "resultset", F.col("id"))
    rows = scan.unplace(scan.run(scan.place(rows, ["_file", "_block", "_mid"]), [], {"rs_id": ("last", opened)}))
    member = rows.filter(F.col("tag") == "ref").select("rs_id", F.col("id").alias("key")).distinct()
    meta = rows.filter(F.col("tag") == "resultset").select("rs_id", F.nullif("name", F.lit("")).alias("name"))
    return member, meta


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, "header", "_VALUE string").select(F.col("_VALUE").alias("header"))


# --- schema files: metadata, on the driver -----------------------------------------------------

_NAMES = "name:array<struct<_lang:string,_VALUE:string>>"
_ATTR = "_id string, _type string, _group string, _max int, _indexed string, " + _NAMES.replace(":", " ", 1)
_SUB = f"qualifiers struct<attribute:array<struct<_id:string,_type:string,_group:string,{_NAMES}>>>"


def _names(rows) -> dict:
    return {(r["_lang"] or ""): r["_VALUE"] for r in rows or []}


def load_schema(spark: SparkSession, path: str, schema_id: str = "") -> Schema:
    """The schema of a file. Unknown types and repeated fields are errors."""
    rows = read_xml_document(spark, path, "attribute", f"{_ATTR}, {_SUB}").collect()
    attrs: dict[str, Attribute] = {}
    for r in rows:
        if r["_id"] in attrs:
            raise SchemaError(f"field {r['_id']!r} is declared twice")
        quals: dict[str, Qualifier] = {}
        for q in (r["qualifiers"]["attribute"] if r["qualifiers"] else None) or []:
            if q["_id"] in quals:
                raise SchemaError(f"qualifier {r['_id']}.{q['_id']} is declared twice")
            quals[q["_id"]] = Qualifier(q["_type"], q["_group"], _names(q["name"]))
        attrs[r["_id"]] = Attribute(
            r["_type"], r["_group"], r["_max"], r["_indexed"] is not None, _names(r["name"]), quals
        )
    return Schema(schema_id, attrs)


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """``(grp, id, parent, names)`` from the taxonomy groups of a schema file, of any depth.

    Tags are rows. The depth is a running sum over them, and whatever stands at a depth belongs
    to the item opened last one level above. A name used twice in a group is an error.
    """
    tags = _tags(spark, path, "txo-group|txo-item|name")
    tags = tags.select(
        "_file", "_block", "_mid", "end", "tag", _attribute("id").alias("id"), F.coalesce(_attribute("lang"), F.lit("")).alias("lang"),
        _unescape(F.regexp_extract("value", r"^[^>]*>([\s\S]*)$", 1)).alias("text"),
        F.col("value").rlike(r"/>\s*$").alias("empty"),
    )
    move = F.when((F.col("tag") != "txo-item") | F.col("empty"), 0).when(F.col("end"), -1).otherwise(1)
    group = F.when((F.col("tag") == "txo-group") & ~F.col("end"), F.col("id"))
    outside = F.when(F.col("tag") == "txo-group", F.col("end"))
    placed = scan.run(
        scan.place(tags, ["_file", "_block", "_mid"]), [],
        {"level": ("sum", move), "grp": ("last", group), "_out": ("last", outside)},
    )
    # Names of attributes stand outside the groups; so do tags before the first one.
    rows = cut(placed.filter(~F.coalesce("_out", F.lit(True)) & ~F.col("end") & (F.col("tag") != "txo-group")))
    item = F.col("tag") == "txo-item"
    level = F.col("level").cast("int") - F.when(item & ~F.col("empty"), 1).otherwise(0)
    own = F.when(item, F.col("id").try_cast("int"))
    # An item opens its level for what stands in it, and asks the level above for its parent.
    asks = rows.select("grp", level.alias("level"), "_at", F.lit(0).alias("_n"), "tag", own.alias("id"), "lang", "text", F.lit(None).cast("int").alias("opens"))
    opens = asks.filter(F.col("tag") == "txo-item").select(
        "grp", (F.col("level") + 1).alias("level"), "_at", F.lit(1).alias("_n"), F.lit("open").alias("tag"), "id", "lang", "text", F.col("id").alias("opens")
    )
    both = asks.unionByName(opens).withColumnRenamed("_at", "_seq")
    found = scan.unplace(scan.run(scan.place(both, ["grp", "level", "_seq", "_n"]), ["grp", "level"], {"parent": ("last", F.col("opens"))}))
    names = found.filter(F.col("tag") == "name").groupBy("grp", F.col("parent").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("names")
    )
    items = found.filter(F.col("tag") == "txo-item").select("grp", "id", "parent")
    items = cut(items.join(names, ["grp", "id"], "left").select("grp", "id", "parent", "names"))
    assert [f.name for f in items.schema] == [c.split()[0] for c in ITEMS.split(", ")]
    twice = check_names(items).first()
    if twice is not None:
        raise SchemaError(f"taxonomy {twice['grp']!r} has the name {twice['name']!r} twice")
    return items
