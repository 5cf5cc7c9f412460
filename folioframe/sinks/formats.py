"""BibTeX, MARC and EndNote files, as lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import collapse_whitespace
from ..functions.latex import latex_encode
from ..session import cut
from . import lines as ln


def _typed(kind: str) -> Column:
    return F.col("type") == kind


# --- BibTeX ---------------------------------------------------------------------------------


def _bibtex_value() -> Column:
    """The text of one value of a field, without the braces around the field."""
    person = F.col("person")
    named = F.when(
        person["first"].isNotNull() & (person["first"] != ""),
        latex_encode(F.concat(person["last"], F.lit(", "), person["first"])),
    ).otherwise(F.concat(F.lit("{"), latex_encode(person["last"]), F.lit("}")))
    return (
        F.when(_typed("text"), latex_encode(collapse_whitespace(F.col("text"))))
        .when(_typed("id"), latex_encode(F.col("text")))
        .when(_typed("url"), F.col("text"))
        .when(_typed("person"), named)
        .when(_typed("date"), F.col("date.year").cast("string"))
        .when(_typed("txo"), latex_encode(F.col("name")))
    )


def bibtex_lines(
    values: DataFrame, items: DataFrame, hooks: dict[str, Callable[[Column], Column]] | None = None,
    keep: DataFrame | None = None,
) -> DataFrame:
    """One entry per record: fields by name, padded to the longest of the record. The id gives the key and the document type the entry type. ``hooks`` changes the text of
    fields, ``keep`` is the set of keys to write."""
    from ..operators.taxonomy import resolve

    if keep is not None:
        values = values.join(keep.select("key").distinct(), "key", "left_semi")
    # Heads, shapes and lines all start from here: make the values once.
    rows = cut(resolve(values, items).select("key", "attr", "pos", "type", "text", "person", "date", "name"))
    # key and type of the entry: the first of each, two short strings per record
    place = lambda attr: F.when((F.col("attr") == attr) & F.col("key").isNotNull(), F.col("pos"))
    heads = rows.groupBy("key").agg(F.min_by("text", place("id")).alias("id"), F.min_by("name", place("doctype")).alias("kind"))
    opened = F.concat(
        F.lit("@"), F.coalesce("kind", F.lit("misc")), F.lit("{"), F.coalesce(F.concat("id", F.lit(",")), F.lit(""))
    )
    fields = rows.filter(~F.col("attr").isin("id", "doctype"))
    # A date is written as its year, under the name readers know.
    fields = fields.withColumn("field", F.when(_typed("date"), "year").otherwise(F.col("attr")))
    lasts = fields.groupBy("key", "field").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    shape = lasts.groupBy("key").agg(F.max("field").alias("_final"), F.max(F.length("field")).alias("_width"))
    fields = fields.join(lasts, ["key", "field"]).join(shape, "key")
    first = F.col("pos") == F.col("_first")
    fields = fields.filter(first | ~_typed("date")).withColumn("_last", F.when(_typed("date"), F.col("_first")).otherwise(F.col("_last")))
    text = _bibtex_value()
    for name, change in (hooks or {}).items():
        text = F.when(F.col("attr") == name, change(text)).otherwise(text)
    joint = F.when(_typed("person"), "and ").when(_typed("url"), ", ").when(_typed("text"), "").otherwise("; ")
    opening = F.concat(F.lit("   "), F.rpad("field", F.col("_width"), F.lit(" ")), F.lit(" = "), F.when(_typed("date"), "").otherwise("{"))
    indent = F.rpad(F.lit(" "), F.col("_width") + 7, F.lit(" "))
    # A value is a line: the first opens the field, the last closes it.
    start = F.when(first, opening).otherwise(F.concat(indent, joint))
    close = F.when(_typed("date"), "").otherwise("}")
    comma = F.when(F.col("field") == F.col("_final"), "").otherwise(",")
    end = F.when(F.col("pos") == F.col("_last"), F.concat(close, comma)).otherwise("")
    body = fields.select("key", F.lit(1).alias("part"), "field", "pos", F.concat(start, text, end).alias("line"))
    return body.unionByName(ln.frame(heads, opened, F.lit("}")))


# --- MARC -----------------------------------------------------------------------------------


def marcxml_lines(cells: DataFrame) -> DataFrame:
    """``cells`` is ``(key, code, n, sub, pos, text)``: code is a control number (``001``) or
    tag and indicators (``245__``, ``_`` for none), n the number of the field with that code,
    sub and pos the subfield. Empty texts are left out."""
    cells = cells.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    control = F.length("code") == 3
    ind = lambda n: F.replace(F.substring("code", n, 1), F.lit("_"), F.lit(""))
    opened = F.concat(
        F.lit('  <datafield tag="'), F.substring("code", 1, 3), F.lit('" ind1="'), ind(4), F.lit('" ind2="'), ind(5), F.lit('">')
    )
    one = F.concat(F.lit('  <controlfield tag="'), F.col("code"), F.lit('">'), ln.escape(F.col("text")), F.lit("</controlfield>"))
    sub = F.concat(F.lit('   <subfield code="'), F.col("sub"), F.lit('">'), ln.escape(F.col("text")), F.lit("</subfield>"))
    field = F.concat_ws("|", "code", F.lpad(F.col("n").cast("string"), 9, "0"))
    place = F.concat_ws("|", field, F.lit("1"), F.col("sub"))
    rows = cells.select(
        "key", F.when(control, 1).otherwise(2).alias("part"), F.when(control, field).otherwise(place).alias("field"),
        F.col("pos"), F.when(control, one).otherwise(sub).alias("line"),
    )
    data = cells.filter(~control).select("key", "code", field.alias("field")).distinct()
    ends = F.array(
        F.struct(F.lit("|0").alias("s"), opened.alias("line")), F.struct(F.lit("|2").alias("s"), F.lit("  </datafield>").alias("line"))
    )
    around = data.select("key", "field", F.explode(ends).alias("_e")).select(
        "key", F.lit(2).alias("part"), F.concat("field", "_e.s").alias("field"), F.lit(0).alias("pos"), "_e.line"
    )
    keys = cells.select("key").distinct()
    return rows.unionByName(around).unionByName(ln.frame(keys, F.lit(" <record>"), F.lit(" </record>")))


# --- EndNote --------------------------------------------------------------------------------

# Reference types by number.
ENDNOTE_TYPES = {
    0: "Journal Article", 1: "Book", 2: "Thesis", 3: "Conference Proceedings",
    4: "Personal Communication", 5: "Newspaper Article", 6: "Computer Program", 7: "Book Section",
    8: "Magazine Article", 9: "Edited Book", 10: "Report", 11: "Map", 12: "Audiovisual Material",
    13: "Artwork", 15: "Patent", 16: "Electronic Source", 17: "Bill", 18: "Case", 19: "Hearing",
    20: "Manuscript", 21: "Film or Broadcast", 22: "Statute", 25: "Figure", 26: "Chart or Table",
    27: "Equation", 31: "Generic",
}


def endnote_text(text: Column) -> Column:
    """Escaped, with every character outside ASCII as a hexadecimal reference."""

    def one(token: Column) -> Column:
        return F.when(token.rlike(r"^[\x00-\x7f]*$"), token).otherwise(
            F.concat(F.lit("&#x"), F.hex(F.ascii(token)), F.lit(";"))
        )

    tokens = F.regexp_extract_all(ln.escape(text), F.lit(r"[\x00-\x7f]+|(?s)."), F.lit(0))
    coded = F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(tokens, one), "")).otherwise(ln.escape(text))
    return F.replace(coded, F.lit("\n"), F.lit("&#xD;"))


def endnote_xml_lines(values: DataFrame, fields: dict[str, str], types: DataFrame) -> DataFrame:
    """``fields`` maps a field to ``ELEMENT``, or ``LIST/ELEMENT`` for lists; ``types`` is
    ``(key, reftype)``. Elements come in the order of ``fields``."""
    whole = F.when(
        _typed("person"),
        F.concat(F.col("person.last"), ln.optional(", ", F.col("person.first"))),
    ).when(_typed("date"), F.col("date.year").cast("string")).otherwise(F.col("text"))
    rows = values.filter(F.col("attr").isin(list(fields))).withColumn("_t", endnote_text(whole)).filter(F.col("_t") != "")
    parts = []
    for n, (field, target) in enumerate(fields.items()):
        mine = rows.filter(F.col("attr") == field)
        head, _, tail = target.partition("/")
        tag = tail or head
        line = F.concat(F.lit(f"<{tag}>"), F.col("_t"), F.lit(f"</{tag}>"))
        place = lambda s, n=n: F.lit(f"{n:04d}|{s}")
        parts.append(mine.select("key", F.lit(2).alias("part"), place("1").alias("field"), "pos", line.alias("line")))
        if tail:
            keys = mine.select("key").distinct()
            for s, text in (("0", f"<{head}>"), ("2", f"</{head}>")):
                parts.append(keys.select("key", F.lit(2).alias("part"), place(s).alias("field"), F.lit(0).alias("pos"), F.lit(text).alias("line")))
    heads = types.select(
        "key", F.lit(1).alias("part"), F.lit("").alias("field"), F.lit(0).alias("pos"),
        F.concat(
            F.lit("<REFERENCE_TYPE>"), F.col("reftype").cast("string"), F.lit("</REFERENCE_TYPE><REFNUM>"),
            F.col("key").cast("string"), F.lit("</REFNUM>"),
        ).alias("line"),
    )
    out = heads.unionByName(ln.frame(types.select("key"), F.lit("<RECORD>"), F.lit("</RECORD>")))
    for part in parts:
        out = out.unionByName(part)
    return out

