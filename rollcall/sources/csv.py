"""CSV exports, read as text, with columns bound by each file's own header.

A single read over files with different headers binds later files by position
and swaps columns without an error. ``read_many`` therefore makes one scan per
distinct header and stacks the scans by name.
"""

from __future__ import annotations

import csv as _csv
import io
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.columns import FILE_ORD, ORD, ROW_ORD, col
from rollcall.functions.text import BLANK_CHARS, empty_default, ws_trim
from rollcall.operators.sets import check_case, union_rows
from rollcall.sources.files import literal_path, plain_path, read_head


@dataclass(frozen=True)
class CsvFormat:
    sep: str = ","
    encoding: str = "UTF-8"
    trim: bool = True
    multiline: bool = True
    duplicate_headers: str = "error"

    def options(self) -> dict[str, object]:
        return {
            "sep": self.sep,
            "encoding": "UTF-8" if self.encoding.lower() == "utf-8-sig" else self.encoding,
            "quote": '"',
            "escape": '"',
            "multiLine": self.multiline,
            "mode": "PERMISSIVE",
            "ignoreLeadingWhiteSpace": self.trim,
            "ignoreTrailingWhiteSpace": self.trim,
        }


@dataclass(frozen=True)
class SourceFile:
    """A file that was found readable; ``header`` is empty for an empty file."""

    path: str
    ord: int
    header: tuple[str, ...] = ()
    uri: str | None = None
    size: int = 0


@dataclass(frozen=True)
class Loaded:
    """Stacked rows with their ordinals, the files read, and those skipped."""

    df: DataFrame
    files: list[SourceFile]
    skipped: dict[str, str] = field(default_factory=dict)


def _fields(head: str | None, fmt: CsvFormat) -> tuple[str, ...]:
    return () if head is None else _names(next(_csv.reader(io.StringIO(head, newline=""), delimiter=fmt.sep)), fmt)


def _names(fields: Sequence[str | None], fmt: CsvFormat) -> tuple[str, ...]:
    names = [(f or "").removeprefix("\ufeff") for f in fields]
    if fmt.trim:
        names = [n.strip(BLANK_CHARS) for n in names]
    return tuple(n or f"_c{i}" for i, n in enumerate(names))


def probe_files(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: CsvFormat = CsvFormat(),
    on_error: str = "skip",
    workers: int = 16,
) -> tuple[list[SourceFile], dict[str, str]]:
    """Headers of many files, and the reason for each unreadable one.

    Like the footers of a Parquet folder, headers are looked at from the driver, several files at
    a time and no more of each than its head: no job runs, whatever the number and size of the files.
    """

    def one(item: tuple[int, str]) -> SourceFile | Exception:
        try:
            head = read_head(spark, item[1], fmt.options()["encoding"], BLANK_CHARS)
            return SourceFile(item[1], item[0], _fields(head.line, fmt), head.uri, head.size)
        except Exception as error:  # noqa: BLE001 - reported or raised below
            if on_error != "skip":
                raise
            return error

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(paths)))) as pool:
        found = list(pool.map(one, enumerate(paths)))
    files = [f for f in found if isinstance(f, SourceFile)]
    skipped = {p: _reason(f) for p, f in zip(paths, found) if isinstance(f, Exception)}
    return files, skipped


def _reason(error: Exception) -> str:
    """What went wrong, without the trace and the name of the call."""
    lines = [x for x in str(error).split("\n") if x.strip() and not x.startswith("An error occurred while calling")]
    return lines[0].removeprefix(": ") if lines else type(error).__name__


def headers(
    spark: SparkSession, paths: Sequence[str], fmt: CsvFormat = CsvFormat()
) -> dict[str, list[str]]:
    files, _ = probe_files(spark, paths, fmt, on_error="raise")
    return {f.path: list(f.header) for f in files}


def _header_columns(header: Sequence[str], fmt: CsvFormat) -> dict[str, int]:
    """Name to position; a repeated name is an error unless its last place is asked for."""
    repeated = sorted({h for h in header if list(header).count(h) > 1})
    if repeated and fmt.duplicate_headers != "last":
        raise ValueError(f"repeated header names: {', '.join(repeated)}")
    return {h: i for i, h in enumerate(header)}


def _text(raw: Column, fmt: CsvFormat) -> Column:
    # The reader trims unquoted values only, and of the plain blanks only.
    value = empty_default(raw)
    return ws_trim(value) if fmt.trim else value


def _positional(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])


def _one_slash(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def with_ord(scan: DataFrame, files: Sequence[SourceFile]) -> DataFrame:
    """The place of each row: that of its file among the inputs, and its number inside the file.

    Must sit directly on the scan. Spark reads a file in splits; the rows before each split are
    counted by the same scan without its columns, so numbers do not depend on how files are cut.
    The two small tables that are broadcast hold a row per file and per split, which the
    driver lists anyway to plan the scan.
    """
    spark = scan.sparkSession
    names = spark.createDataFrame([(_one_slash(f.uri), f.ord) for f in files], f"__uri string, {FILE_ORD} int")
    placed = scan.withColumns(
        {
            "__id": F.monotonically_increasing_id(),
            "__uri": F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"),
            "__begin": F.col("_metadata.file_block_start"),
        }
    )
    splits = placed.groupBy("__uri", "__begin").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("__uri").orderBy("__begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.join(F.broadcast(names), "__uri")
    numbered = placed.join(F.broadcast(starts), ["__uri", "__begin"])
    return numbered.withColumn(ROW_ORD, F.col("__id") - F.col("__first") + F.col("__before")).drop(
        "__id", "__uri", "__begin", "__first", "__before"
    )


def _scan(
    spark: SparkSession,
    files: Sequence[SourceFile],
    columns: Sequence[str],
    fmt: CsvFormat,
    ignore_corrupt: bool,
) -> DataFrame:
    header = files[0].header
    at = _header_columns(header, fmt)
    reader = spark.read.schema(_positional(header)).options(**fmt.options(), header=True)
    raw = reader.option("ignoreCorruptFiles", ignore_corrupt).csv([literal_path(f.path) for f in files])
    placed = with_ord(raw, files)
    values = [
        (_text(F.col(f"_c{at[c]}"), fmt) if c in at else F.lit("")).alias(c) for c in columns
    ]
    return placed.select(*values, *ORD)


def read_many(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: CsvFormat = CsvFormat(),
    on_error: str = "skip",
    ignore_corrupt: bool = False,
) -> Loaded:
    """Read files with differing headers into one table of text columns.

    Columns are the union in first-seen order; what a file lacks is ``''``. With
    ``on_error="skip"`` files that cannot be opened are listed in ``skipped``.
    ``ignore_corrupt`` also lets a file that breaks off half way end there.
    """
    if not paths:
        raise ValueError("no input files")
    files, skipped = probe_files(spark, paths, fmt, on_error)
    if not files:
        raise ValueError(f"none of the {len(paths)} input files can be read")
    groups: dict[tuple[str, ...], list[SourceFile]] = {}
    for f in files:
        if f.header:
            groups.setdefault(f.header, []).append(f)
    columns = list(dict.fromkeys(h for header in groups for h in header))
    if not groups:
        empty = spark.createDataFrame([], f"{FILE_ORD} int, {ROW_ORD} bigint")
        return Loaded(empty, files, skipped)
    scans = [_scan(spark, group, columns, fmt, ignore_corrupt) for group in groups.values()]
    check_case(scans[0], columns)
    return Loaded(union_rows(*scans), files, skipped)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    encoding: str = "utf-8",
    trim: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """Read one file, or a directory or list of files that share one header.

    All headers are looked at first, and one scan reads all files; columns are bound by position, so a header
    may hold blank or padded names. A file with another header is an error; use ``read_many`` for such files.
    """
    fmt = CsvFormat(sep, encoding, trim, multiline)
    paths = sorted(plain_path(uri) for uri in spark.read.text(path).inputFiles())
    files = [f for f in probe_files(spark, paths, fmt, on_error="raise")[0] if f.header]
    if not files:
        return spark.createDataFrame([], T.StructType([]))
    header = files[0].header
    other = [f.path for f in files if f.header != header]
    if other:
        raise ValueError(f"{other[0]} has another header than {files[0].path}")
    _header_columns(header, fmt)
    raw = spark.read.schema(_positional(header)).options(**fmt.options(), header=True).csv(path)
    return raw.select(*[_text(F.col(f"_c{i}"), fmt).alias(h) for i, h in enumerate(header)])


def file_inventory(loaded: Loaded) -> DataFrame:
    """Path, size, rows and columns of each file read."""
    spark = loaded.df.sparkSession
    known = spark.createDataFrame(
        [(f.ord, f.path, f.size, len(f.header)) for f in loaded.files],
        f"{FILE_ORD} int, path string, bytes bigint, columns int",
    )
    counted = loaded.df.groupBy(FILE_ORD).agg(F.count(F.lit(1)).alias("rows"))
    joined = known.join(counted, FILE_ORD, "left")
    return joined.select(FILE_ORD, "path", "bytes", empty_default(col("rows"), 0).alias("rows"), "columns")
