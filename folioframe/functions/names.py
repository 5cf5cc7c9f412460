"""Person names: reading raw name strings, and display forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import person

# Name conventions of the formats, by the number of comma-separated parts they accept.
COMMA_FORMATS = ("ris", "isi", "marc", "endnote", "wok")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _nth(parts: Column, n: int) -> Column:
    return F.try_element_at(parts, F.lit(n))


def person_from_comma(raw: Column, fmt: str) -> Column:
    """``Last, First`` in the convention of a format; NULL where the format rejects the name.

    ris: last, first, lineage, further parts ignored. isi, endnote, wok: exactly two parts,
    anything else is all last name. marc: one or two parts, more are rejected.
    """
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    n = F.size(parts)
    if fmt == "ris":
        return person(_nth(parts, 1), _nth(parts, 2), lineage=_nth(parts, 3))
    two = person(_nth(parts, 2 - 1), _nth(parts, 2))
    if fmt == "marc":
        return F.when(n == 1, person(_nth(parts, 1))).when(n == 2, two)
    if fmt == "isi":
        whole = F.when(n == 1, F.trim(raw)).otherwise(raw)
    elif fmt in ("endnote", "wok"):
        whole = F.trim(raw)
    else:
        raise ValueError(f"unknown name format {fmt!r}")
    return F.when(n == 2, two).otherwise(person(whole))


def collapse_dot_dash(text: Column) -> Column:
    """``J. -D.`` to ``J.-D.``"""
    return F.regexp_replace(text, r"\.\s+-", ".-")


def split_names(raw: Column) -> Column:
    """A name list cut at its top-level ``and``s; empty names are dropped."""
    names = F.split(F.concat(F.lit(" "), raw, F.lit(" ")), r"(?<=\s)and(?=\s)(?![^{}]*(?:\{[^{}]*\}[^{}]*)*\})")
    return F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"^[\s~]+|[\s~]+$", "")), lambda n: n != "")


def name_words(name: Column) -> Column:
    """The words of one name. A dot ends a word, a comma is a word of its own."""
    text = F.regexp_replace(name, r"[{}]", "")
    text = F.regexp_replace(text, r"~", " ")
    text = F.regexp_replace(text, r"\s+\.", ".")
    text = F.regexp_replace(text, r"(\.+)", "$1 ")
    text = F.regexp_replace(text, r",", " , ")
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_types(words: Column) -> Column:
    """One letter per word: I for initials, L for lower case or a particle, N for a name."""
    letter = lambda w: (
        F.when(w.contains("."), "I")
        .when((F.lower(w) == w) | F.lower(w).isin("van", "von", "de"), "L")
        .otherwise("N")
    )
    return F.array_join(F.transform(words, letter), "")


def _join(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def person_rule(name: Column, words: Column, types: Column) -> Column:
    """Which rule reads the name; ``error`` when none does."""
    commas = F.size(F.filter(words, lambda w: w == ","))
    last_word = F.try_element_at(words, F.lit(-1))
    return (
        F.when(name.rlike(r"(?s)^\{(?:[^{}]|\{[^{}]*\})*\}$"), "braced")
        .when(F.size(words) == 0, "empty")
        .when(commas > 1, "error")
        .when(commas == 1, "comma")
        .when(F.size(words) == 1, "single")
        .when(types.rlike("^N+I+$"), "last_initials")
        .when(types == "NN", "first_last")
        .when(types.rlike("^[IN]*?I+N+$"), "initials_last")
        .when(types.contains("L"), "particle")
        .when(types == "NNN", "three_names")
        .when((types == "II") & last_word.endswith(".") & (F.length(last_word) > 2), "final_dot")
        .otherwise("error")
    )


def person_by_rule(rule: Column, name: Column, words: Column, types: Column) -> Column:
    """The person a rule reads from a name; NULL for ``empty`` and ``error``."""
    n = F.size(words)
    comma = F.array_position(words, F.lit(",")).cast("int")
    first_i = F.instr(types, "I")
    last_i = F.length(types) - F.instr(F.reverse(types), "I") + 1
    particle = F.instr(types, "L")
    tidy = collapse_dot_dash
    return (
        F.when(rule == "braced", person(F.regexp_replace(name, r"[{}]", "")))
        .when(rule == "comma", person(_join(words, F.lit(1), comma - 1), tidy(_join(words, comma + 1, F.greatest(n - comma, F.lit(0))))))
        .when(rule == "single", person(_nth(words, 1)))
        .when(rule == "last_initials", person(_join(words, F.lit(1), first_i - 1), tidy(_join(words, first_i, n - first_i + 1))))
        .when(rule == "first_last", person(_nth(words, 2), tidy(_nth(words, 1))))
        .when(rule == "initials_last", person(_join(words, last_i + 1, n - last_i), tidy(_join(words, F.lit(1), last_i))))
        .when(rule == "particle", person(_join(words, particle, n - particle + 1), tidy(_join(words, F.lit(1), particle - 1))))
        .when(rule == "three_names", person(_nth(words, 3), _join(words, F.lit(1), F.lit(2))))
        .when(rule == "final_dot", person(F.regexp_replace(_nth(words, 2), r"\.$", ""), tidy(_nth(words, 1))))
    )


def read_person(name: Column) -> Column:
    """``STRUCT<rule, person>`` of one name. Words and types are bound once, so that the rules
    that look at them many times do not compute them again."""

    def by_types(words: Column, types: Column) -> Column:
        return let(
            person_rule(name, words, types),
            lambda rule: F.struct(rule.alias("rule"), person_by_rule(rule, name, words, types).alias("person")),
        )

    return let(name_words(name), lambda words: let(word_types(words), lambda types: by_types(words, types)))


# --- display forms -------------------------------------------------------------------------


def maybe(text: Column, prefix: str = "", postfix: str = "", default: str = "") -> Column:
    """``text`` between prefix and postfix, or the default when there is none."""
    full = F.concat(F.lit(prefix), text, F.lit(postfix))
    return F.when(text.isNotNull() & (text != ""), full).otherwise(F.lit(default))


def initials(first: Column) -> Column:
    """``Jean-Daniel`` to ``J.-D.``; a short word in capitals is initials already."""
    spaced = F.regexp_replace(F.regexp_replace(first, "-", " - "), r"\.", " ")
    parts = F.filter(F.split(spaced, r"\s+"), lambda p: p != "")
    cut = F.array_join(F.transform(parts, lambda p: F.when(p == "-", p).otherwise(F.concat(F.left(p, F.lit(1)), F.lit(".")))), "")
    packed = (F.upper(first) == first) & (F.length(first) < 4) & ~first.rlike(r"[.\s-]")
    return F.when(first != "", F.when(packed, F.regexp_replace(first, "(.)", "$1.")).otherwise(cut))


def last_first(p: Column) -> Column:
    return F.concat(p["last"], maybe(p["first"], prefix=", "))


def first_last(p: Column) -> Column:
    return F.concat(maybe(p["first"], postfix=" "), p["last"])


def initial_last(p: Column) -> Column:
    return F.concat(maybe(initials(p["first"]), postfix=" "), p["last"])
