"""BibTeX files.

The text source cuts files at line starts with ``@``; a small helper splits each piece into
fields inside the task. Everything after that is expressions and joins: macros, accents,
names, dates, document types.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import month_number
from ..functions.latex import latex_decode
from ..functions.names import let, read_person, split_names
from ..model import Schema, partial_date, txo, union_all, values_of
from ..operators.taxonomy import by_name
from ..plans import scan
from ..session import cut
from .common import Ingest, file_place, keyed, violations

# The helper travels with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The macros every file may use.
MONTH_MACROS = {
    "jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June",
    "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December",
}

_ENTRIES = (
    "_file string, _block bigint, at int, kind string, type string, cite_key string, "
    "fields array<struct<name:string,parts:array<struct<bare:boolean,text:string>>>>, raw string"
)
_START = re.compile(r"^[^\S\n]*@[^\S\n]*(\w+)([^\n]*)", re.M)
_TOKEN = re.compile(r"\\(?:\w+|\S|\s)?|[{}\"(),#=]|\s+|[^\\{}\"(),#=\s]+")


class _Unbalanced(ValueError):
    pass


def _stream(text: str, start: int) -> tuple[list[tuple[str, str]], int]:
    """Tokens of one entry body, ``(kind, text)``, and where it ends. Kinds: lit for text in
    braces or quotes, sep, word."""
    tokens = iter(_TOKEN.finditer(text, start))
    closing = None
    out: list[tuple[str, str]] = []
    joined = False  # the last word may go on
    for m in tokens:
        t = m.group()
        if closing is None:
            if t.isspace():
                continue
            if t not in ("{", "("):
                raise _Unbalanced("no opening brace")
            closing = "}" if t == "{" else ")"
            continue
        if t == closing:
            return out, m.end()
        if t == "}":
            raise _Unbalanced("unexpected closing brace")
        if t in ("{", '"'):
            depth, body = (1, []) if t == "{" else (0, [])
            for m in tokens:
                u = m.group()
                depth += (u == "{") - (u == "}")
                if (t == "{" and depth == 0) or (t == '"' and u == '"' and depth == 0):
                    break
                if depth < 0:
                    raise _Unbalanced("unexpected closing brace")
                body.append(u)
            else:
                raise _Unbalanced("open brace or quote")
            out.append(("lit", "".join(body)))
            joined = False
        elif t in (",", "#", "="):
            out.append(("sep", t))
            joined = False
        elif t.isspace():
            joined = False
        elif joined:
            out[-1] = ("word", out[-1][1] + t)
        else:
            out.append(("word", t))
            joined = True
    raise _Unbalanced("open entry")


def _fields(stream: list[tuple[str, str]]) -> tuple[str | None, dict[str, list[tuple[bool, str]]]]:
    """Key and fields of a token stream. A comma that is missing between fields is forgiven."""
    key, fields, n = None, {}, 0
    while n < len(stream):
        name = stream[n][1]
        n += 1
        if n == len(stream) or stream[n] == ("sep", ","):
            if key is not None or fields:
                raise _Unbalanced("stray key")
            key, n = name, n + 1
            continue
        if stream[n] != ("sep", "="):
            raise _Unbalanced(f"no value for {name}")
        n += 1
        parts: list[tuple[bool, str]] = []
        while n < len(stream) and stream[n] != ("sep", ","):
            if parts:
                if stream[n] != ("sep", "#"):
                    if stream[n][0] == "word":
                        break
                    raise _Unbalanced(f"parts of {name} are not joined")
                n += 1
                if n == len(stream):
                    raise _Unbalanced(f"{name} ends with #")
            kind, text = stream[n]
            parts.append((kind == "word" and not text.isdigit(), text))
            n += 1
        if n < len(stream) and stream[n] == ("sep", ","):
            n += 1
        fields[name.lower()] = parts
    return key, fields


def entries(text: str) -> Iterator[tuple]:
    """``(kind, type, key, fields, raw)`` of each entry in a piece of a file; what is outside
    of entries is comment."""
    at = 0
    while m := _START.search(text, at):
        kind = m.group(1).lower()
        if kind == "comment":
            at = m.end()
            continue
        try:
            stream, end = _stream(text, m.end(1))
            key, fields = _fields(stream)
        except _Unbalanced as error:
            yield ("error", kind, str(error), {}, text[m.start():])
            return
        yield ("string" if kind == "string" else "skip" if kind == "preamble" else "entry", kind, key, fields, None)
        at = end


def _parsed(pieces: list[str]) -> list[tuple]:
    found = list(entries("\n".join(pieces)))
    if len(pieces) > 1 and any(e[0] == "error" for e in found):
        return [e for piece in pieces for e in entries(piece)]
    return found


_BRACE = re.compile(r"\\.|([{}])", re.S)


def _open_braces(text: str) -> int:
    return sum(1 if b == "{" else -1 for b in _BRACE.findall(text) if b)


def _rows(place: tuple, at: int, pieces: list[str]) -> list[tuple]:
    out = []
    for kind, type_, key, fields, raw in _parsed(pieces):
        nested = [{"name": n, "parts": [{"bare": b, "text": t} for b, t in parts]} for n, parts in fields.items()]
        out.append((*place, at, kind, type_, key, nested, raw))
        at += kind == "entry"
    return out


# The same columns for Arrow: nested rows go out without a conversion of each value through pandas.
_FIELD = pa.struct([("name", pa.string()), ("parts", pa.list_(pa.struct([("bare", pa.bool_()), ("text", pa.string())])))])
_COLUMNS = pa.schema([
    ("_file", pa.string()), ("_block", pa.int64()), ("at", pa.int32()), ("kind", pa.string()), ("type", pa.string()),
    ("cite_key", pa.string()), ("fields", pa.list_(_FIELD)), ("raw", pa.string()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COLUMNS)], schema=_COLUMNS)


def _lists(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in columns))


_OPEN, _REST = "open", "rest"  # kinds of rows for an entry that goes on in the next block


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the pieces of a partition. ``at`` counts the entries of each block.

    ``skip`` pieces of a block belong to an entry of an earlier one, and ``lone`` are those that never
    close and stand alone. From there a piece takes others in until its braces are closed.
    """
    columns = ["_file", "_block", "value", "skip", "lone"]
    lines = (row for batch in batches for row in _lists(batch, columns))
    rows: list[tuple] = []
    for (file, start), block in groupby(lines, key=lambda row: row[:2]):
        at, depth, held, rest = 0, 0, [], []
        for n, (*_, value, skip, lone) in enumerate(block):
            # The separator took the @, except at the start of a file.
            piece = value if n == 0 and start == 0 else "@" + value
            if n < skip:
                rest.append(piece)
                continue
            if lone is not None and n in lone:
                new = _rows((file, start), at, [piece])
            else:
                held.append(piece)
                depth += _open_braces(piece)
                if depth > 0:
                    continue
                new, held, depth = _rows((file, start), at, held), [], 0
            rows += new
            at += sum(r[3] == "entry" for r in new)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        for kind, pieces in ((_OPEN, held), (_REST, rest)):
            if pieces:
                rows.append((file, start, at, kind, None, None, [], "\n".join(pieces)))
    yield _batch(rows)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that were put together from several blocks."""
    for batch in batches:
        rows: list[tuple] = []
        for file, start, at, raw in _lists(batch, ["_file", "_block", "at", "raw"]):
            first, *others = raw.split("\n@")
            rows += _rows((file, start), at, [first, *("@" + p for p in others)])
        yield _batch(rows)


def _net_braces() -> Column:
    without = lambda b: F.length(F.replace("value", F.lit(b)))
    count = lambda b: F.length(F.regexp_replace("value", rf"(?s)\\.|[^{b}]", ""))
    return F.when(F.contains("value", F.lit("\\")), count("{") - count("}")).otherwise(without("}") - without("{"))


def _starts(slim: DataFrame) -> DataFrame:
    """``slim`` (``_file, _block, _mid, _d``: net braces of a piece) with ``_lone`` for the pieces that never
    close, ``_first`` for those that start an entry of their own, and the running sum ``_p``.

    With P the running sum of open braces in a file, a piece closes at the first P that is not
    above the P before it. So pieces before which P is below all that follows never close; they
    stand alone and what comes after is taken for itself. Of the other pieces, those start an
    entry before which P is the least so far. Running sums and minima spread over any number of blocks;
    the rows are numbers, the text is not shuffled.
    """
    place = ["_file", "_block", "_mid"]
    rows = scan.unplace(scan.run(scan.place(slim, place), ["_file"], {"_p": ("sum", F.col("_d"))}))
    back = scan.place(rows, ["_file", F.desc("_block"), F.desc("_mid")])
    back = scan.unplace(scan.run(back, ["_file"], {"_least": ("min", F.col("_p"))}))  # from here to the end
    before = F.col("_p") - F.col("_d")
    back = back.withColumn("_lone", before < F.col("_least")).drop("_least")
    # Sections of a file: each piece that stands alone starts a new one.
    rows = scan.run(scan.place(back, place), ["_file"], {"_section": ("count", F.when(F.col("_lone"), 1))})
    rows = scan.run(rows, ["_file", "_section"], {"_low": ("min", F.col("_p"))}, inclusive=False)
    low = F.when(F.col("_section") == 0, F.least(F.coalesce("_low", F.lit(0)), F.lit(0))).otherwise(F.col("_low"))
    return rows.withColumn("_first", F.col("_lone") | (before <= low))


def _borders(pieces: DataFrame) -> DataFrame:
    """``(_file, _block, skip, lone, owner)`` for the blocks that do not start with an entry of their own, or
    have pieces that never close."""
    slim = pieces.select("_file", "_block", F.monotonically_increasing_id().alias("_mid"), _net_braces().alias("_d"))
    rows = _starts(slim)
    rows = scan.unplace(scan.run(rows, ["_file"], {"owner": ("last", F.when(F.col("_first"), F.col("_block")))}))
    start = F.min("_mid")
    blocks = rows.groupBy("_file", "_block").agg(
        F.coalesce(F.min(F.when(F.col("_first"), F.col("_mid"))) - start, F.count(F.lit(1))).alias("skip"),
        F.collect_list(F.when(F.col("_lone"), F.col("_mid"))).alias("_lones"),
        start.alias("_start"),
        F.min_by("owner", "_mid").alias("owner"),
    )
    lone = F.transform("_lones", lambda n: n - F.col("_start"))
    return blocks.select("_file", "_block", "skip", lone.alias("lone"), "owner").filter((F.col("skip") > 0) | (F.size("lone") > 0))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    # A later block also starts after an @ the separator took: its first piece is not a file start.
    pieces = spark.read.option("lineSep", "\n@").text(path).select(*file_place(), "value")
    if pieces.filter(_net_braces() != 0).isEmpty():  # every piece is closed, as in most files
        return pieces.select("*", F.lit(0).alias("skip"), F.lit(None).cast("array<bigint>").alias("lone")).mapInArrow(_split, _ENTRIES)
    borders = cut(_borders(pieces))
    # One row at most for each block of the files; a shuffle would lose the order of the pieces.
    marks = F.broadcast(borders.select("_file", "_block", "skip", "lone"))
    marked = pieces.join(marks, ["_file", "_block"], "left").withColumn("skip", F.coalesce("skip", F.lit(0)))
    rows = marked.mapInArrow(_split, _ENTRIES)
    if borders.filter("skip > 0").isEmpty():
        return rows
    rows = cut(rows)
    text = F.struct(F.col("_block").alias("from"), "raw").alias("text")
    opened = rows.filter(F.col("kind") == _OPEN).select("_file", "_block", "at", text)
    rest = rows.filter(F.col("kind") == _REST).join(borders, ["_file", "_block"])
    rest = rest.select("_file", F.col("owner").alias("_block"), F.lit(None).cast("int").alias("at"), text)
    whole = opened.union(rest).groupBy("_file", "_block").agg(
        F.max("at").alias("at"), F.array_join(F.sort_array(F.collect_list("text"))["raw"], "\n").alias("raw")
    )
    return rows.filter(~F.col("kind").isin(_OPEN, _REST)).unionByName(whole.mapInArrow(_finish, _ENTRIES))


def _expand(fields: DataFrame, strings: DataFrame) -> DataFrame:
    """``(key, type, name, raw)``: parts joined, macros replaced. Only fields that use macros
    are taken apart; all others keep their row."""
    plain = fields.filter(~F.exists("parts", lambda p: p["bare"]))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    plain = plain.select("key", "name", joined.alias("raw"))
    months = F.create_map(*[F.lit(x) for pair in MONTH_MACROS.items() for x in pair])
    parts = fields.filter(F.exists("parts", lambda p: p["bare"])).select(
        "_file", "_block", "_mid", "key", "name", F.posexplode("parts").alias("n", "p")
    )
    parts = parts.select(
        "_file", "_block", "_mid", "key", "name", "n", "p.text", F.when(F.col("p.bare"), F.lower("p.text")).alias("macro")
    )
    # A use takes the last definition before it: definitions and uses in file order.
    order = ["_file", "macro", "_block", "_mid", "key", "name", "n"]
    uses = parts.filter(F.col("macro").isNotNull()).unionByName(strings, allowMissingColumns=True)
    known = scan.run(scan.place(uses, order), ["_file", "macro"], {"definition": ("last", F.col("defined"))})
    known = scan.unplace(known).filter(F.col("key").isNotNull()).drop("defined")
    resolved = parts.filter(F.col("macro").isNull()).unionByName(known, allowMissingColumns=True)
    text = F.when(F.col("macro").isNull(), F.col("text")).otherwise(
        F.coalesce("definition", F.try_element_at(months, F.col("macro")), "text")
    )
    ordered = F.sort_array(F.collect_list(F.struct("n", text.alias("t"))))
    used = resolved.groupBy("key", "name").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "").alias("raw"))
    return plain.unionByName(used)


def ingest_bibtex(
    spark: SparkSession, path: str, schema: Schema, items: DataFrame,
    hooks: dict[str, Callable[[Column], Column]] | None = None, keep: Callable[[], Column] | None = None,
) -> Ingest:
    """Reads BibTeX. ``hooks`` maps a field to a change of its raw text; ``keep`` is a
    condition on entries (columns type, cite_key, fields) to leave some out."""
    parsed = read_entries(spark, path).withColumn("_entry", F.when(F.col("kind") == "entry", F.col("at")))
    entry_rows = keyed(parsed, index="_entry", keep_file=True)
    found = entry_rows.filter(F.col("kind") == "entry")
    if keep is not None:
        found = found.filter(keep())
    strings = (
        entry_rows.filter(F.col("kind") == "string")
        .select("_file", "_block", "_mid", F.explode("fields").alias("f"))
        .select(
            "_file", "_block", "_mid", F.col("f.name").alias("macro"),
            F.array_join(F.transform(F.col("f.parts"), lambda p: p["text"]), "").alias("defined"),
        )
    )
    place = ["_file", "_block", "_mid", "key"]
    fields = _expand(found.select(*place, F.explode("fields").alias("f")).select(*place, "f.*"), strings)
    for name, change in (hooks or {}).items():
        fields = fields.withColumn("raw", F.when(F.col("name") == name, change(F.col("raw"))).otherwise(F.col("raw")))

    # Every type of field starts from here: take the entries apart and replace macros once.
    fields = cut(fields)

    by_type: dict[str, list[str]] = {}
    for name, attr in schema.attrs.items():
        by_type.setdefault(attr.type, []).append(name)
    of = lambda kind: fields.filter(F.col("name").isin([n for n in by_type.get(kind, []) if n not in ("date",)]))
    zero = F.lit(0)

    def typed(kind: str, text: Column) -> DataFrame:
        return values_of(of(kind), F.col("key"), F.col("name"), zero, kind, text, present=F.col("raw").isNotNull())

    names = of("person").select("key", "name", F.posexplode(split_names(F.col("raw"))).alias("pos", "one"))
    whole = F.col("one").rlike(r"^\{(?:[^{}]|\{[^{}]*\})*\}$")
    plain = latex_decode(F.col("one"))
    text = F.when(whole, F.concat(F.lit("{"), plain, F.lit("}"))).otherwise(plain)
    names = names.withColumn("_read", let(text, read_person))
    # One branch takes the persons, another the names nobody can read: read them once.
    names = cut(names.select("key", "name", "pos", "one", "_read.rule", "_read.person"))
    # A name that cannot be read leaves no gap: the fields that have one are counted anew.
    odd = names.filter(F.col("person").isNull()).select("key", "name").distinct()
    people = names.filter(F.col("person").isNotNull())
    people = people.join(odd, ["key", "name"], "left_anti").unionByName(
        scan.dense(people.join(odd, ["key", "name"], "left_semi").select(*names.columns), ["key", "name"])
    )

    named = found.select("key", "cite_key", F.lower("type").alias("type"))
    coded = by_name(named, items, schema.attrs["doctype"].grp, "type")
    when = fields.filter(F.col("name").isin("year", "month")).withColumn("text", F.trim(latex_decode(F.col("raw"))))
    dates = when.filter(F.col("text") != "").groupBy("key").agg(
        F.max(F.when(F.col("name") == "year", F.col("text").try_cast("int"))).alias("y"),
        F.max(F.when(F.col("name") == "month", month_number(F.col("text")))).alias("m"),
    )
    dated = F.col("y").isNotNull() | F.col("m").isNotNull()
    values = union_all(
        [
            typed("text", latex_decode(F.col("raw"))),
            typed("url", F.regexp_replace(F.replace(F.col("raw"), F.lit("\u00a0"), F.lit("~")), r"[\\{}]", "")),
            typed("id", F.col("raw")),
            values_of(people, F.col("key"), F.col("name"), F.col("pos"), "person", F.col("person"), present=F.col("person").isNotNull()),
            values_of(named, F.col("key"), "id", zero, "id", F.col("cite_key")),
            values_of(coded, F.col("key"), "doctype", zero, "txo", F.when(F.col("id").isNotNull(), txo("doctype", F.col("id")))),
            values_of(dates, F.col("key"), "date", zero, "date", F.when(dated, partial_date(F.col("y"), F.col("m")))),
        ]
    )
    known = list(schema.attrs) + ["year", "month"]
    bad_year = when.filter((F.col("name") == "year") & (F.col("text") != "") & F.col("text").try_cast("int").isNull())
    bad_month = when.filter((F.col("name") == "month") & (F.col("text") != "") & month_number(F.col("text")).isNull())
    wrong = union_all(
        [
            violations(entry_rows.filter(F.col("kind") == "error"), F.lit(None), "unbalanced", F.col("raw")),
            violations(fields.filter(~F.col("name").isin(known)), F.col("name"), "unknown_attribute", F.col("name")),
            violations(names.filter(F.col("rule") == "error"), F.col("name"), "unreadable", F.col("one"), F.col("pos")),
            violations(coded.filter(F.col("id").isNull()), F.lit("doctype"), "unknown_item", F.col("type")),
            violations(bad_year, F.lit("date"), "unreadable", F.col("text")),
            violations(bad_month, F.lit("date"), "unreadable", F.col("text")),
        ]
    )
    return Ingest(values, wrong, spark.createDataFrame([], "tag string, n bigint"))
