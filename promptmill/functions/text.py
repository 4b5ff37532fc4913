"""Text helpers with the blank and line rules of Python strings.

Spark's ``trim`` only removes U+0020 and Java's ``\\s`` is ASCII only, so the
blank set is spelled out once here and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Python's str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a regex character class body.
BLANK_CLASS = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# The line ends of Python's str.splitlines().
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"


def as_column(value: Column | str) -> Column:
    """A column name becomes a column; columns pass through."""
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(as_column(value), F.lit(BLANKS))


def rstrip(value: Column | str) -> Column:
    return F.rtrim(as_column(value), F.lit(BLANKS))


def split_lines(value: Column | str) -> Column:
    return F.split(as_column(value), LINE_END)


def split_words(value: Column | str) -> Column:
    """Words between blanks; an empty array for blank text."""
    text = strip(value)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"[{BLANK_CLASS}]+"))


def text_after(value: Column, marker: str) -> Column:
    """What follows the first ``marker``; only call where it occurs."""
    return F.substr(value, F.position(F.lit(marker), value) + F.lit(len(marker)))
