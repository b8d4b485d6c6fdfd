"""Character classes, patterns and text columns.

Every pattern is written in the common subset of Java and RE2 syntax, so the
same string serves Spark and the DuckDB checks.  Classes follow Python's
``str`` predicates, which are wider than the regex shorthands ``\\s`` and ``\\d``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# What str.isspace / str.split treat as blank.
SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# What the bytes 0x80 to 0xBF decode to in Windows-1252.
MOJIBAKE_TAIL = r"[\x{a0}-\x{bf}ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]"
ASCII_PUNCT = r"\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}"
EMAIL = rf"^[^@{SPACE}]+@[^@{SPACE}]+\.[^@{SPACE}]+\n?\z"
URL_EXPLICIT = rf"(?:https?://|www\.)[^{SPACE}]+"
URL_BARE = rf"(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{{2,}}(?:/[^{SPACE}]*)?"
URL_SHAPE = rf"^(?:{URL_EXPLICIT}|{URL_BARE})\n?\z"
URL_SHAPE_ANY_CASE = "(?i)" + URL_SHAPE
US_DATE = r"^\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4}\n?\z"
DATE_SHAPE = (
    r"^(?:\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}(?:[T ]\p{Nd}{2}:\p{Nd}{2}(?::\p{Nd}{2})?)?"
    r"|\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4})\n?\z"
)
NUMERIC = r"^-?\p{Nd}+(?:\.\p{Nd}+)?\n?\z"
INTEGER = r"^-?\p{Nd}+\z"
_DIGITS = r"\p{Nd}(?:_?\p{Nd})*"
FLOAT = (
    rf"^[{SPACE}]*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|(?i:inf|infinity|nan))[{SPACE}]*\z"
)
NON_ASCII = r"[^\x{00}-\x{7f}]"
# ----------------------------------------------------------------------------


def ascii_first(plain: str, members: str) -> str:
    """The class ``[members]`` for Java alone; ``plain`` are its members below 0x80.

    Java asks the parts of a class one by one.  Here an ASCII character is settled by the short
    list, and only others go through the long one.
    """
    return rf"[{plain}[\x{{80}}-\x{{10ffff}}&&[{members}]]]"


BLANK = ascii_first(r"\x{09}-\x{0d}\x{1c}-\x{20}", SPACE)



def _ranges(points: list[int]) -> str:
    """Code points as the inside of a regex character class."""
    out: list[str] = []
    for point in points:
        if out and point == end + 1:
            end = point
            out[-1] = f"\\x{{{start:x}}}-\\x{{{end:x}}}"
        else:
            start = end = point
            out.append(f"\\x{{{point:x}}}")
    return "".join(out)


@lru_cache(maxsize=None)
def digit_class() -> str:
    """``str.isdigit``: decimal digits plus superscripts, circled digits and their like."""
    extra = [
        c for c in range(0x80, 0x20000)
        if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"
    ]
    return r"[\p{Nd}" + _ranges(extra) + "]"


def mojibake() -> str:
    """A lead character of UTF-8 read as Windows-1252, and one that can follow it."""
    return f"[ÃÂ]{MOJIBAKE_TAIL}|â€{MOJIBAKE_TAIL}"


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of ``text`` fall in ``char_class`` (whole runs drop out per match)."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens, none empty."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Blanks removed on both sides, Unicode blanks included."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def collapse(text: Column) -> Column:
    """Every run of blanks becomes one space; none stay at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def nfkc(text: Column) -> Column:
    """Unicode NFKC inside the JVM.

    Spark has no function for it, but ships ICU, whose ``compose(text, true)``
    is reachable by name.  ASCII text is a fixed point and skips the call.
    """
    composed = F.call_function(
        "reflect",
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True),
    )
    return F.when(text.rlike(NON_ASCII), composed).otherwise(text)


def filled(text: Column) -> Column:
    """``text``, or null where it is empty; ``text`` is computed once, where nullif would compute it twice."""
    return F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))


def shuffle_key(text: Column) -> Column:
    """Stand-in for ``text`` in groupings: values over 96 characters travel as their SHA-512.

    The digest has 128 hex digits, so it can't equal a value that travels as it is.
    """
    return F.when(F.length(text) > 96, F.sha2(text, 512)).otherwise(text)
