"""Leaf blocks of an HTML page: texts between block-level tags, with the elements they stand in."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|iframe)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNQUOTED = re.compile(r"=\s*[^\s\"'=]+/\Z")  # a slash that belongs to a value
_WORD = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
# Blocks of their own that may stand in a paragraph without ending it.
_EMBEDDED = frozenset("object canvas noscript svg".split())
_FOREIGN = frozenset("svg math".split())  # here a tag may close itself, and math runs on in its line
_HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mtext".split())  # inside them
# Start tags that end an svg or math that was left open.
_LEAVES = frozenset(
    "b big blockquote body center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag ends these open elements of the same list.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"},
}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot select article section main div body html td th".split())


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]  # words of class, id, role and itemprop


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]
    linked: int  # characters inside links
    first: bool  # right after its element began


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role", "itemprop"):
            value = re.sub(r"([a-z])(?=\d)|[-_]", r"\1 ", value)
            found += _WORD.findall(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.append("hidden")
    return tuple(found)


def page_blocks(page: str) -> list[Block]:
    """Blocks with any text, in page order, with character references decoded and white space single."""
    out: list[Block] = []
    stack: list[Element] = []
    text: list[str] = []
    linked: list[str] = []
    fresh = True

    def close() -> None:
        nonlocal fresh
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            link = len(" ".join(html.unescape("".join(linked)).split()))
            out.append(Block(joined, tuple(e for e in stack if e.tag not in INLINE), link, fresh))
            fresh = False
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if any(e.tag == "a" for e in stack):
            linked.append(piece)

    def end(tag: str) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at].tag == tag:
                del stack[at:]
                return
            if tag in INLINE and stack[at].tag not in INLINE:
                return

    def foreign() -> int | None:
        """Where the svg or math begins that the place is in."""
        for at in range(len(stack) - 1, -1, -1):
            if stack[at].tag in _FOREIGN:
                return at
            if stack[at].tag in _HTML_AGAIN:
                return None
        return None

    at = 0
    for match in _MARKUP.finditer(page):
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        tag = (match["name"] or match["name2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        ends = bool(match["end"] or match["end2"])
        inside = foreign()
        if inside is not None and not ends and tag in _LEAVES:
            close()
            del stack[inside:]
            inside = None
        formula = inside is not None and stack[inside].tag == "math"
        if formula and ends:  # an end tag from outside ends the formula with its block
            formula = any(e.tag == tag for e in stack[inside:])
        inline = tag in INLINE or tag == "math" or formula
        if not inline:
            close()
        if ends:
            end(tag)
            continue
        attributes = match["attributes"] or match["attributes2"] or ""
        own = inside is not None or tag in _FOREIGN
        if own and attributes.endswith("/") and not _UNQUOTED.search(attributes):
            continue
        if not inline:
            fresh = True
        if not inline and not own and tag not in _EMBEDDED:
            while stack and stack[-1].tag in INLINE:  # formatting left open ends with its block
                stack.pop()
            if stack and stack[-1].tag == "p":
                stack.pop()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in _ENDS.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        if tag not in VOID:
            stack.append(Element(tag, _names(attributes)))
    if at < len(page):
        add(page[at:])
    close()
    return out
