"""Names of the survey columns, and checks on column names.

A survey table is long: one row per answer, every column text. Operators find
their columns through one :class:`SurveyColumns`, so a table with other names
needs only another instance of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import BLANK_CHARS

# Row kinds found in the ``QuestionsType`` column.
END_TIME = "end_time"
INCENTIVES = "Incentives"
AUDIO_KINDS = ("textaudio", "audio")

# Columns that must be present before duplicates can be cleaned.
CLEANING_COLUMNS = ("PromptID", "ParticipantID", "RespondedAt", "Date")

# Columns of the transcript extract.
TRANSCRIPT_COLUMNS = ("Date", "Reference", "Transcript")

#: Columns added by the file readers: position of the file in the list of
#: inputs, and an id that grows with the row's position inside the file.
FILE_ORD = "_file_ord"
ROW_ORD = "_row_ord"
ORD = (FILE_ORD, ROW_ORD)


@dataclass(frozen=True)
class SurveyColumns:
    response_id: str = "ResponseID"
    participant: str = "ParticipantID"
    kind: str = "QuestionsType"
    response: str = "Response"
    responded_at: str = "RespondedAt"
    date: str = "Date"
    prompt: str = "PromptID"
    reference: str = "Reference"
    transcript: str = "Transcript"

    @property
    def cleaning_keys(self) -> tuple[str, str, str]:
        return (self.prompt, self.participant, self.responded_at)


DEFAULT_COLUMNS = SurveyColumns()


def name(column: str) -> str:
    """Quote a column name so that dots and dashes in it stay literal."""
    return "`" + column.replace("`", "``") + "`"


def col(column: str) -> Column:
    return F.col(name(column))


def order_names(order_by: str | Sequence[str] | None) -> list[str]:
    """Check the ordering columns of an operator whose result depends on order.

    Spark rows have no position, so "first", "last" and ties mean nothing
    without columns that give each row its place.
    """
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not names:
        raise ValueError("order_by is required: it must give every row its own place")
    return names


#: Rows that a file can have; the place of a row among all files is a number with this base.
_ROWS = "9223372036854775808"


def order_value(order_by: Sequence[str]) -> Column:
    """The ordering columns as one comparable value.

    The file readers' two ordinals make one number: its least value is kept in the buffer of a hash
    aggregate, where that of a struct would need all rows sorted.
    """
    if len(order_by) == 1:
        return col(order_by[0])
    if tuple(order_by) == ORD:
        return col(FILE_ORD).cast("decimal(38,0)") * F.lit(_ROWS).cast("decimal(19,0)") + col(ROW_ORD)
    return F.struct(*[col(c) for c in order_by])


def order_parts(order_by: Sequence[str], place: Column) -> dict[str, Column]:
    """The ordering columns from their value."""
    if len(order_by) == 1:
        return {order_by[0]: place}
    if tuple(order_by) == ORD:
        base = F.lit(_ROWS).cast("decimal(19,0)")
        row = place % base
        return {FILE_ORD: ((place - row) / base).cast("int"), ROW_ORD: row.cast("bigint")}
    return {c: place.getField(c) for c in order_by}


def norm_header(header: str) -> str:
    """Header text reduced to the form in which headers are compared."""
    bare = (header or "").removeprefix("\ufeff").strip(BLANK_CHARS).lower()
    return re.sub("[-_" + BLANK_CHARS + "]", "", bare)


def norm_header_text(header: Column) -> Column:
    """The same for header text in a column."""
    bare = F.regexp_replace(F.coalesce(header, F.lit("")), "^\ufeff", "")
    return F.regexp_replace(F.lower(F.trim(bare, F.lit(BLANK_CHARS))), "[-_" + BLANK_CHARS + "]", "")


def resolve_columns(
    columns: Iterable[str], wanted: Sequence[str] = CLEANING_COLUMNS
) -> dict[str, str]:
    """Map each wanted name to the first column whose header reduces to it."""
    found: dict[str, str] = {}
    for column in columns:
        found.setdefault(norm_header(column), column)
    return {w: found[norm_header(w)] for w in wanted if norm_header(w) in found}


def rename_resolved(df: DataFrame, wanted: Sequence[str] = CLEANING_COLUMNS) -> DataFrame:
    """Give loosely written headers their proper names; fail if one is absent."""
    resolved = resolve_columns(df.columns, wanted)
    missing = [w for w in wanted if w not in resolved]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumnsRenamed({old: new for new, old in resolved.items()})


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
