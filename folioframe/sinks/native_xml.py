"""The native XML format, as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Schema
from ..operators.taxonomy import closure
from . import lines as ln


def _own(v, kind: str) -> Column:
    """The attributes of an element."""
    if kind == "person":
        return F.concat(*[ln.optional(f" {p}=", _q(v["person"][p])) for p in ("honorific", "first", "last", "lineage")])
    if kind == "date":
        return F.concat(*[ln.optional(f' {p}="', v["date"][p].cast("string"), '"') for p in ("year", "month", "day")])
    if kind == "url":
        return F.concat(F.lit(" href="), ln.quoted(v["text"]))
    if kind == "id":
        return F.concat(F.lit(" value="), ln.quoted(v["text"]))
    return F.concat(F.lit(" group="), ln.quoted(v["txo"]["grp"]), F.lit(' id="'), v["txo"]["id"].cast("string"), F.lit('"'))


def _q(text: Column) -> Column:
    return F.when(text.isNotNull() & (text != ""), ln.quoted(text))


def _element(v, indent: int, inner: Column | None = None) -> Column:
    """One value, in one line, or in several when ``inner`` holds qualifiers."""
    pad = " " * indent
    inner = F.lit("") if inner is None else inner
    out = F.when(
        v["type"] == "text",
        F.when(inner == "", F.concat(F.lit(f"{pad}<text>"), ln.escape(v["text"]), F.lit("</text>"))).otherwise(
            F.concat(F.lit(f"{pad}<text>\n{pad} <content>"), ln.escape(v["text"]), F.lit("</content>\n"), inner, F.lit(f"{pad}</text>"))
        ),
    )
    for kind in ("person", "date", "url", "id", "txo"):
        head = F.concat(F.lit(f"{pad}<{kind}"), _own(v, kind))
        whole = F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(
            F.concat(head, F.lit(">\n"), inner, F.lit(f"{pad}</{kind}>"))
        )
        out = out.when(v["type"] == kind, whole)
    return out


def _qualifiers(indent: int) -> Column:
    """The qualifiers of a value, by name and place. They sit in the row of their value."""
    names = F.array_sort(F.array_distinct(F.transform("quals", lambda q: q["name"])))
    pad = " " * indent

    def block(name: Column) -> Column:
        mine = F.array_sort(
            F.filter("quals", lambda q: q["name"] == name), lambda a, b: (a["pos"] - b["pos"]).cast("int")
        )
        body = F.array_join(F.transform(mine, lambda q: F.concat(_element(q, indent + 1), F.lit("\n"))), "")
        return F.concat(F.lit(f"{pad}<attribute id="), ln.quoted(name), F.lit(">\n"), body, F.lit(f"{pad}</attribute>\n"))

    return F.array_join(F.transform(names, block), "")


class _Row:
    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def entry_lines(values: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Entries with their fields in order of name. ``keys`` adds records without values."""
    keys = values.select("key").distinct() if keys is None else keys
    # Qualifiers first: their text goes into the line at several places.
    inner = F.when(F.size("quals") > 0, _qualifiers(4)).otherwise("")
    rows = values.withColumn("_inner", inner)
    rows = rows.select("key", "attr", "pos", _element(_Row(), 3, F.col("_inner")).alias("_line"))
    line = F.struct(F.col("pos").alias("at"), F.col("_line").alias("line"))
    opening = F.struct(F.lit(ln.BEFORE).alias("at"), F.concat(F.lit("  <attribute id="), ln.quoted(F.col("attr")), F.lit(">")).alias("line"))
    closing = F.struct(F.lit(ln.AFTER).alias("at"), F.lit("  </attribute>").alias("line"))
    # A field has its lines around it wherever its values start.
    fields = values.select("key", "attr").distinct()
    around = fields.select("key", "attr", F.explode(F.array(opening, closing)).alias("_l"))
    body = rows.select("key", "attr", line.alias("_l")).unionByName(around)
    body = body.select("key", F.lit(1).alias("part"), F.col("attr").alias("field"), F.col("_l.at").alias("pos"), "_l.line")
    opened = F.concat(F.lit(' <entry id="'), F.col("key").cast("string"), F.lit('">'))
    return body.unionByName(ln.frame(keys, opened, F.lit(" </entry>")))


def set_lines(member: DataFrame, meta: DataFrame) -> DataFrame:
    """Result sets; the key of a line is the set."""
    refs = member.select(
        F.col("rs_id").alias("key"), F.lit(1).alias("part"), F.lit("").alias("field"), F.col("key").alias("pos"),
        F.concat(F.lit('  <ref id="'), F.col("key").cast("string"), F.lit('"/>')).alias("line"),
    )
    named = meta.select(F.col("rs_id").alias("key"), "name")
    opened = F.concat(
        F.lit(' <resultset id="'), F.col("key").cast("string"), F.lit('"'),
        F.coalesce(F.concat(F.lit(" name="), ln.quoted(F.col("name"))), F.lit("")), F.lit(">"),
    )
    return refs.unionByName(ln.frame(named, opened, F.lit(" </resultset>")))


def write_sets(lines: DataFrame, path: str) -> None:
    """A large set may span several files, so the range includes the place in the set."""
    order = ("key", "part", "pos")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def schema_text(schema: Schema) -> list[str]:
    """The lines of the attribute declarations. Metadata, on the driver."""
    from xml.sax.saxutils import escape, quoteattr

    out: list[str] = []

    def declare(name, attr, pad, quals):
        extra = (f" group={quoteattr(attr.grp)}" if attr.grp else "") + (
            f' max="{attr.max_n}"' if getattr(attr, "max_n", None) else ""
        ) + (' indexed="1"' if getattr(attr, "indexed", False) else "")
        out.append(f"{pad}<attribute id={quoteattr(name)} type={quoteattr(attr.type)}{extra}>")
        for lang, text in attr.names.items():
            out.append(f"{pad} <name{f' lang={quoteattr(lang)}' if lang else ''}>{escape(text)}</name>")
        if quals:
            out.append(f"{pad} <qualifiers>")
            for q, d in sorted(quals.items()):
                declare(q, d, pad + "  ", {})
            out.append(f"{pad} </qualifiers>")
        out.append(f"{pad}</attribute>")

    for name in sorted(schema.attrs):
        declare(name, schema.attrs[name], " ", schema.attrs[name].quals)
    return out


def item_lines(items: DataFrame) -> DataFrame:
    """``(grp, path, pos, line)`` of the taxonomy groups. An item opens at its path from the
    root and closes behind everything below it, so nesting is just an order of lines."""
    steps = closure(items, distances=True).groupBy("grp", "id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), F.col("ancestor").alias("a")))).alias("_s")
    )
    # a path is as long as the tree is deep
    rows = items.join(steps.select("grp", "id", F.col("_s.a").alias("path")), ["grp", "id"])
    pad = F.rpad(F.lit(" "), F.size("path") + 1, F.lit(" "))

    def name(e: Column) -> Column:
        lang = F.when(e["key"] == "", F.lit("")).otherwise(F.concat(F.lit(" lang="), ln.quoted(e["key"])))
        return F.concat(pad, F.lit(" <name"), lang, F.lit(">"), ln.escape(e["value"]), F.lit("</name>\n"))

    names = F.array_join(F.transform(F.array_sort(F.map_entries("names")), name), "")
    opened = F.concat(pad, F.lit('<txo-item id="'), F.col("id").cast("string"), F.lit('">\n'), names)
    ends = F.array(
        F.struct(F.col("path").alias("path"), F.regexp_replace(opened, r"\n$", "").alias("line")),
        F.struct(F.concat("path", F.array(F.lit(ln.AFTER))).alias("path"), F.concat(pad, F.lit("</txo-item>")).alias("line")),
    )
    body = rows.select("grp", F.explode_outer(ends).alias("_e")).select("grp", "_e.path", "_e.line")
    groups = items.select("grp").distinct()
    around = F.array(
        F.struct(F.array(F.lit(ln.BEFORE)).alias("path"), F.concat(F.lit(" <txo-group id="), ln.quoted(F.col("grp")), F.lit(">")).alias("line")),
        F.struct(F.array(F.lit(ln.AFTER), F.lit(ln.AFTER)).alias("path"), F.lit(" </txo-group>").alias("line")),
    )
    frame = groups.select("grp", F.explode(around).alias("_e")).select("grp", "_e.path", "_e.line")
    return body.unionByName(frame)


def write_items(lines: DataFrame, path: str) -> None:
    """A large group may span several files, which follow each other in order."""
    lines.repartitionByRange("grp", "path").sortWithinPartitions("grp", "path").select("line").write.text(path)


def write_database(
    path: str, values: DataFrame, schema: Schema, member: DataFrame, meta: DataFrame, header: str = "",
    items: DataFrame | None = None,
) -> None:
    """Entries, sets, schema, taxonomies and header of a database, each in a folder of its own."""
    if items is not None:
        write_items(item_lines(items), f"{path}/items")
    spark = values.sparkSession
    ln.write(entry_lines(values), f"{path}/entries")
    write_sets(set_lines(member, meta), f"{path}/sets")
    text = "\n".join(["<schema>", *schema_text(schema), "</schema>"])
    spark.createDataFrame([(text,)], "line string").coalesce(1).write.text(f"{path}/schema")
    head = spark.createDataFrame([(header,)], "header string").select(
        F.concat(F.lit("<header>"), ln.escape(F.col("header")), F.lit("</header>")).alias("line")
    )
    head.coalesce(1).write.text(f"{path}/header")
