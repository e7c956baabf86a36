"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes. Spark's one-argument trim()
# only knows the plain space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# the same set as a regular expression for any number of them
SPACES = "[" + "".join(f"\\x{{{ord(s):x}}}" for s in WHITESPACE) + "]*"

UNKNOWN = "n/a"


def strip(c: Column) -> Column:
    """Trim every Unicode space from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL, empty and all-space text count as blank."""
    return F.coalesce(strip(c), F.lit("")) == ""


def padded(pattern: str) -> str:
    """A regular expression for a whole text made of ``pattern`` (group 1) and outer spaces."""
    return f"^{SPACES}({pattern}){SPACES}$"


def lookup(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, NULL when it is not listed."""
    entries = [F.lit(part) for pair in labels.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), c)


def decode(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; anything not listed, NULL included, is unknown."""
    return F.coalesce(lookup(c, labels), F.lit(UNKNOWN))


def decode_code(c: Column, labels: dict[str, str]) -> Column:
    """``decode`` for padded codes in either case."""
    return decode(F.upper(strip(c)), labels)


def plain_number(c: Column, places: int) -> Column:
    """Fixed-point text without thousands separators, ties to even on the exact value."""
    return F.translate(F.format_number(c, places), ",", "")


def grouped_number(c: Column, places: int = 0) -> Column:
    """Fixed-point text with thousands separators."""
    return F.format_number(c, places)
