"""Column functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(c: Column | str) -> Column:
    """Trimmed, in lower case; null becomes empty. Numbers keep their digits, so 0 is not empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def tokens(c: Column | str) -> Column:
    """The distinct search tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(norm(c), F.lit(r"[a-z0-9_./:@+-]{2,}"), F.lit(0)))


def unquote(c: Column) -> Column:
    """Without one pair of quotes around it."""
    return F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")


def first_token(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^(\S+)", 1)


def basename(c: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def printable_hex(c: Column) -> Column:
    """A hexadecimal string of eight digits or more as text, if nine of ten of its bytes are printable; else the string itself. NUL bytes become blanks."""
    digits = F.when((F.length(c) >= 8) & (F.length(c) % 2 == 0) & c.rlike("^[0-9A-Fa-f]+$"), c)
    text = F.decode(F.unhex(digits), "ISO-8859-1")
    shown = F.length(F.regexp_replace(text, r"[^\x20-\x7e\x00\t\n\r]", ""))
    return F.when(shown >= 0.9 * F.length(text), F.trim(F.translate(text, "\x00", " "))).otherwise(c)
