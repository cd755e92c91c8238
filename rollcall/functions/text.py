"""Text expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as blank at the ends of a value (tab, line
# ends, vertical tab, form feed, space, the Unicode space separators, byte order mark).
BLANK_CHARS = (
    "\t\n\v\f\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Words that mean "no value" when they fill a key column.
BLANK_WORDS = ("", "none", "null", "undefined")

# Most keys are told from a blank word by their first character alone.
_FIRST = sorted({*BLANK_CHARS, *(w[:1] for w in BLANK_WORDS), *(w[:1].upper() for w in BLANK_WORDS)})


def ws_trim(column: Column) -> Column:
    """Strip every kind of blank; plain ``trim`` strips the space only."""
    return F.trim(column, F.lit(BLANK_CHARS))


def empty_default(column: Column, value: object = "") -> Column:
    return F.coalesce(column, F.lit(value))


def is_blank_word(column: Column) -> Column:
    """True for null, blank text and the words that stand for a missing value."""
    word = F.lower(ws_trim(column)).isin(*BLANK_WORDS)
    return F.when(F.left(column, F.lit(1)).isin(*_FIRST), word).otherwise(column.isNull())


def has_blank_key(keys: list[Column]) -> Column:
    return reduce(or_, [is_blank_word(k) for k in keys])
