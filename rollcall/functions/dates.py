"""Calendar days of answer times, and their labels.

Days are text of the form ``YYYY-MM-DD``: that is what names the day columns of
a summary, and it lets a malformed day still count in a participant's total.
Run with ``spark.sql.session.timeZone`` set to UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.columns import DEFAULT_COLUMNS, SurveyColumns, col
from rollcall.functions.text import empty_default, ws_trim

# Shape of a day, and label patterns.
DAY_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DAY_PATTERN = "yyyy-MM-dd"
MONTH_PATTERN = "MMM"
WEEKDAY_PATTERN = "EEEE"

# Shapes of free-form date text that are read; text of any other shape has no day.
# They keep time-only text and bare numbers out, which Spark turns into odd dates.
ISO_SHAPE = (
    r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
)
# The other shapes, each with the pattern that reads it once commas are gone and months are cut to three letters.
DAY_SHAPES = {
    r"\d{1,2}/\d{1,2}/\d{4}": "M/d/yyyy",
    r"\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d",
    r"\d{1,2}-\d{1,2}-\d{4}": "M-d-yyyy",
    r"[A-Z][a-z]{2,} \d{1,2},? \d{4}": "MMM d yyyy",
    r"\d{1,2} [A-Z][a-z]{2,},? \d{4}": "d MMM yyyy",
}
TIME_SHAPES = {r"\d{1,2}:\d{2}(?::\d{2})? ?[AaPp][Mm]": "h:mm[:ss]a", r"\d{1,2}:\d{2}(?::\d{2})?": "H:mm[:ss]"}
ZONE_SHAPE = r"(?:GMT|UTC|Z)?(?:[+-]\d{2}:?\d{2})?"
WEEKDAY_PREFIX = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?"
#: Groups: day, time, zone. What stands in brackets behind them names the zone once more.
OTHER_SHAPE = (
    rf"^{WEEKDAY_PREFIX}({'|'.join(DAY_SHAPES)})"
    rf"(?:,? ({'|'.join(TIME_SHAPES)}))?(?: ?({ZONE_SHAPE}))?(?: \([^()]*\))?$"
)
OTHER_PATTERN = "".join(f"[{p}]" for p in DAY_SHAPES.values()) + "".join(f"[ {p}]" for p in TIME_SHAPES.values())


def _other_instant(text: Column) -> Column:
    """Text of one of the other shapes as a timestamp. Without a zone it is in the session's."""
    day, time, zone = (F.regexp_extract(text, OTHER_SHAPE, i) for i in (1, 2, 3))
    short = F.regexp_replace(F.replace(day, F.lit(",")), "([A-Z][a-z]{2})[a-z]+", "$1")
    clock = F.replace(time, F.lit(" "))
    local = F.try_to_timestamp(F.concat(short, F.when(time != "", F.concat(F.lit(" "), clock)).otherwise("")), F.lit(OTHER_PATTERN))
    offset = F.regexp_extract(zone, r"([+-]\d{2}):?(\d{2})$", 1), F.regexp_extract(zone, r"([+-])\d{2}:?(\d{2})$", 2)
    hours, minutes = offset[0].try_cast("int"), offset[1].try_cast("int")
    behind = F.when(hours.isNull(), 0).otherwise(hours * 60 + F.when(F.contains(zone, F.lit("-")), -minutes).otherwise(minutes))
    return local - F.make_dt_interval(mins=behind)


def parse_instant(column: Column) -> Column:
    """Free-form date text as a timestamp; null if its shape is not known."""
    text = ws_trim(column)
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text)).when(text.rlike(OTHER_SHAPE), _other_instant(text))


def iso_day(column: Column) -> Column:
    """A date or timestamp as ``YYYY-MM-DD``."""
    return F.date_format(column, DAY_PATTERN)


def event_day(column: Column, policy: str = "text") -> Column:
    """The day of an answer time.

    ``text``: what stands before the first ``T``, unchecked; text without a ``T``
    is parsed. ``utc``: always parsed, and the day is that of the instant in UTC.
    Both give null where there is no day.
    """
    parsed = iso_day(parse_instant(column))
    if policy == "utc":
        return parsed
    if policy != "text":
        raise ValueError(f"policy must be 'text' or 'utc', not {policy!r}")
    before_t = F.substring_index(column, "T", 1)
    return F.when(F.contains(column, F.lit("T")), F.nullif(before_t, F.lit(""))).otherwise(parsed)


def is_day_text(column: Column) -> Column:
    return column.rlike(DAY_SHAPE)


def rolled_date(day: Column) -> Column:
    """The day text as a date; months and days beyond their end run on (``2025-02-30`` is March 2)."""
    year, month, rest = (day.substr(a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    start = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.when(is_day_text(day), F.date_add(start, rest - 1))


def _part(day: Column, start: int, length: int, most: int) -> Column:
    """A number of the day text, if it can be one of a month or day."""
    number = F.when(is_day_text(day), day.substr(start, length)).try_cast("int")
    return F.when(number.between(1, most), number)


def label_day(day: Column) -> Column:
    """The day of the month, as written: labels do not roll over (``2025-02-30`` is 30)."""
    return F.when(_part(day, 6, 2, 12).isNotNull(), _part(day, 9, 2, 31))


def label_month(day: Column) -> Column:
    month = F.make_date(F.lit(2000), _part(day, 6, 2, 12), F.lit(1))
    return F.when(_part(day, 9, 2, 31).isNotNull(), F.date_format(month, MONTH_PATTERN))


def label_short(day: Column) -> Column:
    return F.concat(label_month(day), F.lit(" "), label_day(day).cast("string"))


def label_weekday(day: Column) -> Column:
    """The weekday's first letter; days beyond the end of a month are counted on."""
    known = label_day(day).isNotNull()
    return F.when(known, F.substring(F.date_format(rolled_date(day), WEEKDAY_PATTERN), 1, 1))


def days_back(day: Column, n: int) -> Column:
    """First day of the ``n`` days that end with ``day``."""
    return iso_day(F.date_sub(rolled_date(day), n - 1))


def day_range(anchor: dt.date | str, n: int = 30) -> list[str]:
    """The ``n`` days that end with the anchor, newest first."""
    end = dt.date.fromisoformat(str(anchor))
    return [(end - dt.timedelta(days=i)).isoformat() for i in range(n)]


def day_sequence(spark: SparkSession, anchor: dt.date | str, n: int = 30) -> DataFrame:
    """The same days as a one-column frame."""
    end = F.to_date(F.lit(str(anchor)))
    days = F.sequence(end, F.date_sub(end, n - 1), F.expr("interval -1 day"))
    return spark.range(1).select(F.explode(days).alias("d")).select(iso_day(F.col("d")).alias("day"))


def answer_time(cols: SurveyColumns = DEFAULT_COLUMNS) -> Column:
    """``RespondedAt`` if filled, else ``Date``; null if both are empty."""
    return F.coalesce(
        F.nullif(col(cols.responded_at), F.lit("")), F.nullif(col(cols.date), F.lit(""))
    )


def incentive_time(cols: SurveyColumns = DEFAULT_COLUMNS) -> Column:
    """Answer time of an incentive row, else its ``Response`` if that holds a ``T``."""
    response = col(cols.response)
    return empty_default(
        F.coalesce(answer_time(cols), F.when(F.contains(response, F.lit("T")), response))
    )
