"""Number expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, each 1024 times the one before.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

# Shape and greatest value of an id that sorts as a whole number.
INTEGER_ID = r"^(0|[1-9][0-9]{0,9})$"
MAX_INTEGER_ID = 4294967294


def round_half_up2(column: Column) -> Column:
    """Two decimals, rounding the scaled double half up.

    ``round`` works on the decimal text of the number, so it gives 1.01 for
    1.005, whose double lies below that tie.
    """
    return F.floor(column.cast("double") * 100 + 0.5) / F.lit(100.0)


def id_rank(column: Column) -> Column:
    """Sort value of an id: its number if it is a plain whole number, else above all of those."""
    number = F.when(column.rlike(INTEGER_ID), column.cast("bigint"))
    return F.least(number, F.lit(MAX_INTEGER_ID + 1))


def size_label(size: Column) -> Column:
    """Bytes as short text: ``0 B``, ``512 B``, ``1.5 MB``."""
    label = F.when(size.isNull() | (size <= 0), F.lit("0 B"))
    for power, unit in enumerate(SIZE_UNITS):
        scaled = size.cast("double") / F.lit(float(1024**power))
        text = F.format_string("%.0f B" if power == 0 else f"%.1f {unit}", scaled)
        if power == len(SIZE_UNITS) - 1:
            return label.otherwise(text)
        label = label.when(size < 1024 ** (power + 1), text)
    raise AssertionError("unreachable")


def parse_days_option(option: str | int | None) -> int | None:
    """Number of days asked for, or None for no limit.

    Takes the leading whole number of the text (``"7days"`` is 7); ``all``, other
    text and numbers below 1 mean no limit.
    """
    digits = re.match(r"\s*[+-]?\d+", str(option))
    days = int(digits.group()) if digits else 0
    return days if days > 0 else None
