"""Citation styles as Column expressions.

A missing part is NULL: ``concat`` hands it on, ``coalesce`` replaces it, ``join`` leaves it
out. ``html`` and ``text`` give the marks of an output; a style takes one of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import first_last


@dataclass(frozen=True)
class Many:
    """A list whose items are spliced into a join."""

    items: Column


def both(*parts: Column) -> Column:
    """Concatenation, missing if a part is."""
    return F.concat(*parts)


def either(*parts: Column) -> Column:
    """The first part that is not missing."""
    return F.coalesce(*parts)


def join(*parts: Column | Many, mid: str = "", last: str | None = None) -> Column:
    """The present parts with ``mid`` between them, and ``last`` before the last one."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(p.items, none) if isinstance(p, Many) else F.array(p) for p in parts]
    present = F.array_compact(F.concat(*lists) if len(lists) > 1 else lists[0])
    n = F.size(present)
    joined = F.array_join(present, mid)
    if last is not None:
        head = F.array_join(F.slice(present, F.lit(1), n - 1), mid)
        joined = F.when(n > 1, F.concat(head, F.lit(last), F.try_element_at(present, F.lit(-1)))).otherwise(joined)
    return F.when(n > 0, joined)


def switch(name: Column, cases: dict[str, Column], default: Column | None = None) -> Column:
    """A part by taxonomy name; missing if no case fits and there is no default. A record
    without the taxonomy value is missing, too."""
    chosen = F.lit(None).cast("string") if default is None else default
    for case, part in reversed(cases.items()):
        chosen = F.when(name == case, part).otherwise(chosen)
    return F.when(name.isNotNull(), chosen)


def i18n(texts: Column, language: str) -> Column:
    return F.coalesce(F.try_element_at(texts, F.lit(language)), F.try_element_at(texts, F.lit("")))


def plural(items: Column, more: Column, zero=None, one=None, two=None) -> Column:
    """A part by the number of items; missing when the list is."""
    out = more
    for n, part in ((2, two), (1, one), (0, zero)):
        if part is not None:
            out = F.when(F.size(items) == n, part).otherwise(out)
    return F.when(items.isNotNull(), out)


# --- outputs -------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _element(name: str):
    def mark(content: Column, **attributes: str) -> Column:
        given = "".join(f' {k.lstrip("_")}="{v}"' for k, v in attributes.items())
        return F.concat(F.lit(f"<{name}{given}>"), content, F.lit(f"</{name}>"))

    return mark


def _html_link(content: Column, href: Column) -> Column:
    return F.concat(F.lit('<a href="'), F.replace(escape(href), F.lit('"'), F.lit("&quot;")), F.lit('">'), content, F.lit("</a>"))


def _plain(content: Column, **_: str) -> Column:
    return content


html = SimpleNamespace(
    text=escape, i=_element("i"), b=_element("b"), small=_element("small"), span=_element("span"),
    a=_html_link, br=lambda: F.lit("<br>"),
)
text = SimpleNamespace(
    text=lambda c: c, i=_plain, b=_plain, small=_plain, span=_plain,
    a=lambda content, href: F.concat(content, F.lit(" <"), href, F.lit(">")), br=lambda: F.lit("\n"),
)


# --- styles --------------------------------------------------------------------------------
# They read the columns authors (ARRAY<person>), title, journal, volume, number, pages, year,
# doctype (name) and abstract of a reference row; any of them may be NULL.


def chicago(people: Column) -> Column:
    items = Many(people)
    return plural(people, one=join(items), two=join(items, mid=" and "), more=join(items, mid=", ", last=", and "))


def author_part(out) -> Column:
    return chicago(F.transform("authors", lambda p: out.text(first_last(p))))


def journal_part(out) -> Column:
    t = lambda n: out.text(F.col(n))
    issue = join(
        join(t("volume"), t("number"), mid=":"),
        both(F.lit("("), t("pages"), F.lit(")")),
    )
    return join(out.i(t("journal")), issue, year_part(), mid=", ")


def year_part() -> Column:
    return F.col("year").cast("string")


def place_part(out) -> Column:
    return switch(F.col("doctype"), {"article": journal_part(out)}, default=year_part())


def plain(out) -> Column:
    return both(join(author_part(out), out.text(F.col("title")), place_part(out), mid=". "), F.lit("."))


def full(out) -> Column:
    return join(
        out.span(out.text(F.col("title")), size="large", weight="bold"),
        out.span(author_part(out), size="large"),
        out.span(place_part(out), size="large"),
        out.span(out.text(F.col("abstract")), color="#505050"),
        mid="\n",
    )
