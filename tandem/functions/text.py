"""Text expressions on built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space in a text.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern; ranges keep the test of a character short.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The spellings accepted as a number, and as a whole number.
DIGITS = r"\d+(?:_\d+)*"
INTEGER = rf"^[+-]?{DIGITS}$"
NUMBER = (
    rf"^[+-]?(?:(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?"
    r"|(?i:inf|infinity|nan))$"
)


def strip(text: Column) -> Column:
    """Remove white space (Unicode) from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Words between runs of white space; never an empty word."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def is_number(text: Column) -> Column:
    return strip(text).rlike(NUMBER)


def to_integer(text: Column) -> Column:
    """BIGINT for whole numbers, NULL for any other spelling."""
    plain = strip(text)
    return F.when(plain.rlike(INTEGER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("bigint"))


def to_float(text: Column) -> Column:
    """DOUBLE for every accepted spelling of a number, NULL otherwise."""
    plain = strip(text)
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
