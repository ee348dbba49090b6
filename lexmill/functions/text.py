"""Character classes and text scalars as column expressions; nothing here leaves the JVM.

Java's \\w and \\s are ASCII, Python's are not, and RE2 knows neither; all classes are therefore
spelled out, so that Spark, DuckDB and Python agree.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as whitespace (Unicode White_Space and U+001C to U+001F).
#: Single code points below 256 become one bit set in Java's patterns and \p{Z} one look at the
#: character's type; written as ranges the same class takes ten times as long.
WHITESPACE = r"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}"
#: The same without the line breaks \n and \r.
INLINE_SPACE = r"\x09\x0b\x0c\x1c\x1d\x1e\x1f\x20\x85\xa0\p{Z}"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c)[0] == "Z" or c in "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x85")
ALNUM = r"\p{L}\p{N}"
LINE_BREAK = r"\r\n|\r|\n"


def collapse_space(text: Column) -> Column:
    """Each run of whitespace becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def stripped_lines(text: Column) -> Column:
    """The lines with something on them, stripped, of a text that is itself stripped; [''] for an empty text."""
    return F.split(text, f"[{INLINE_SPACE}]*+[\\r\\n][{WHITESPACE}]*+")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{ALNUM}]+"), F.lit(0))


def count_of(text: Column, char_class: str) -> Column:
    """Number of code points of text in a class (given without brackets)."""
    return F.char_length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{WHITESPACE}]")
