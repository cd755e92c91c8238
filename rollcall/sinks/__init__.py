"""Writers. Each output is a folder of part files written by all tasks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from rollcall.columns import ORD, TRANSCRIPT_COLUMNS, col, order_names
from rollcall.operators.cleaning import clean
from rollcall.operators.rows import day_columns, in_input_order, report_columns, transcripts

# CSV format of every output. A value is quoted only when it holds
# the separator, a quote or a line end; inner quotes are doubled.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None
) -> None:
    """Write CSV; a path that ends in ``.gz`` asks for gzip unless told otherwise."""
    codec = compression or ("gzip" if path.endswith(".gz") else "none")
    out = df.drop(*ORD)
    out.write.mode(mode).options(**CSV_OPTIONS, compression=codec).csv(path)


def dated_path(base: str, run_date: dt.date | str) -> str:
    """``out/data.csv`` on a date as ``out/data_2025-08-14.csv``."""
    day = dt.date.fromisoformat(str(run_date)).isoformat()
    head, slash, tail = base.rpartition("/")
    stem, dot, suffix = tail.partition(".")
    return f"{head}{slash}{stem}_{day}{dot}{suffix}"


def write_report(
    summary: DataFrame | Sequence[DataFrame],
    audio: DataFrame | None,
    path: str,
    include_incentive: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Participation report: the summary, and the audio summary beside it.

    A summary in pages is written side by side, as ``summary/page=0`` and so on.
    """
    if isinstance(summary, DataFrame):
        write_csv(report_columns(summary, "TotalEntries", include_incentive), f"{path}/summary", mode)
    else:
        for i, page in enumerate(summary):
            shown = page.select("ParticipantID", *day_columns(page)) if i else report_columns(page, "TotalEntries", include_incentive)
            write_csv(shown, f"{path}/summary/page={i}", mode)
    if audio is not None:
        write_csv(report_columns(audio, "TotalTextAudio"), f"{path}/audio", mode)


def write_cleaned(
    df: DataFrame, path: str, order_by: Sequence[str] = ORD, mode: str = "errorifexists"
) -> None:
    """Rows without upload repeats, original columns, in input order."""
    order = order_names(order_by)
    # The sort samples its input first; spread by place, the rows are read from this shuffle both times.
    spread = clean(df, order_by=order).repartition(*[col(c) for c in order])
    write_csv(in_input_order(spread, order), path, mode)


def write_transcripts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(transcripts(df).select(*TRANSCRIPT_COLUMNS), path, mode)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
