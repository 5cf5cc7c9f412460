"""LaTeX-coded text to Unicode and back, one pass per text."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import let

# Accent commands and the combining marks they stand for.
MARKS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307",
    '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331",
}


def accents() -> dict[str, str]:
    """Accent command and letter to the letter with its accent, for all that Unicode composes."""
    pairs = ((command + x, unicodedata.normalize("NFC", x + mark)) for command, mark in MARKS.items() for x in string.ascii_letters)
    return {coded: char for coded, char in pairs if len(char) == 1}


# Commands that stand for a character.
SYMBOLS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ",
    "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "copyright": "©",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(_quoted(x) for pair in pairs.items() for x in pair) + ")")


# A command with its argument, or plain text, or a single brace. One alternative always fits.
_TOKEN = "|".join(
    [
        r"\\['`^\"~.=]\s*(?:\{\s*\\?[A-Za-z]\s*\}|\\[ij]\b|[A-Za-z])",
        r"\\[uHvrdckb](?:\s*\{\s*\\?[A-Za-z]\s*\}|\s+\\?[A-Za-z]\b)",
        r"\\[A-Za-z]+[0-9]*(?:\{\})?",
        r"\\[^A-Za-z]",
        r"[^\\{}]+",
        r"(?s).",
    ]
)


def latex_decode(text: Column) -> Column:
    """Accents, ligatures and ``\\charN`` to characters; braces that only group are dropped."""
    accent_map, symbol_map, mark_map = _literal_map(accents()), _literal_map(SYMBOLS), _literal_map(MARKS)

    def command(token: Column, bare: Column) -> Column:
        number = F.regexp_extract(bare, r"^char(\d+)$", 1).try_cast("int")
        # UTF-32 takes the code point as it is.
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        accented = token.rlike(r"^\\(?:['`^\"~.=]\s*[A-Za-z{\\]|[uHvrdckb][\s{])")
        # A pair that Unicode does not compose stays a letter and its mark.
        loose = F.concat(F.substring(bare, 2, 1), F.try_element_at(mark_map, F.substring(bare, 1, 1)))
        return (
            F.when(accented, F.coalesce(F.try_element_at(accent_map, bare), loose))
            .when(bare.rlike(r"^char\d+$"), char)
            .when(token.rlike(r"^\\[A-Za-z]"), F.coalesce(F.try_element_at(symbol_map, bare), bare))
            .otherwise(F.substring(token, 2, 1))
        )

    def one(token: Column) -> Column:
        plain = F.when(token.isin("{", "}"), "").otherwise(token)
        coded = let(F.regexp_replace(token, r"[\\{}\s]", ""), lambda bare: command(token, bare))
        return F.when(token.startswith("\\"), coded).otherwise(plain)

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.when(text.rlike(r"[\\{}]"), F.array_join(F.transform(tokens, one), "")).otherwise(text)


def accent_code(command: str, letter: str) -> str:
    """``\\'e``; an accented i or j loses its dot; a letter as command has to end before its argument."""
    if letter in "ij" and command != ".":
        letter = "{\\" + letter + "}"
    elif command.isalpha():
        letter = "{" + letter + "}"
    return "\\" + command + letter


def latex_encode(text: Column) -> Column:
    """Every character outside plain ASCII, and ``{ } % \\ $``, as a command."""
    table = {char: accent_code(coded[0], coded[1]) for coded, char in accents().items()}
    table.update({b: "\\" + a + "{}" for a, b in SYMBOLS.items()})
    commands = _literal_map(table)
    plain = r"[ !-#&-\[\]-z|~\x7f]+"

    def one(token: Column) -> Column:
        return F.when(token.rlike(f"^{plain}$"), token).otherwise(
            F.coalesce(
                F.try_element_at(commands, token),
                F.concat(F.lit("\\char"), F.ascii(token).cast("string"), F.lit("{}")),
            )
        )

    tokens = F.regexp_extract_all(text, F.lit(f"{plain}|(?s)."), F.lit(0))
    return F.when(text.rlike(f"^(?:{plain})?$"), text).otherwise(F.array_join(F.transform(tokens, one), ""))
