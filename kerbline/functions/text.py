"""Text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
PIN_PATTERN = r"Pin-?\s?(\d{6})"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
# The characters Python counts as white space.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def literal(value: str) -> str:
    """A SQL string literal (one expression text is far cheaper to build than many columns)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def cleaned(text: Column, default: str) -> Column:
    return stripped(F.coalesce(text, F.lit(default)))


def canonical(text: Column, synonyms: dict[str, str]) -> Column:
    """Whole-value replacement; everything else passes."""
    moved = [(a, b) for a, b in synonyms.items() if a != b]
    start = F.when(text == moved[0][0], moved[0][1])
    return reduce(lambda c, ab: c.when(text == ab[0], ab[1]), moved[1:], start).otherwise(text)


def pin_code(address: Column) -> Column:
    found = F.regexp_extract(address, PIN_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("none"))


def has_text(text: Column) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) > 0).cast("int")


def clipped_length(text: Column, most: int = 200) -> Column:
    return F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(most))


def has_non_ascii(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NON_ASCII_PATTERN).cast("int")
