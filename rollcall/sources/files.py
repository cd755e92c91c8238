"""Input paths: which files to read, in what order, and what became of every input."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the suffix that files given by name or by glob must have.
CSV_SUFFIX = ".csv"

READ = "read"
TWICE = "given before"
NOTHING = "matches nothing"
OTHER_SUFFIX = f"does not end in {CSV_SUFFIX}"
HIDDEN = "Spark reads no names that begin with _ or ."


def plain_path(uri: str) -> str:
    """``file:///a/b%20c`` as ``/a/b c``; other schemes keep their prefix."""
    parsed = urlparse(uri)
    return unquote(parsed.path if parsed.scheme == "file" else uri)


def literal_path(path: str) -> str:
    """A path in which no character is read as part of a glob."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def unique_paths(paths: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(paths))


@dataclass(frozen=True)
class Found:
    """The files to read, in order, and (input, path, fate) of everything that was looked at.

    An input that leads to no file has one row without a path.
    """

    paths: list[str]
    fates: list[tuple[str, str | None, str]] = field(default_factory=list)

    @property
    def skipped(self) -> dict[str, str]:
        """What was given but is not read, and why."""
        return {path or item: fate for item, path, fate in self.fates if fate not in (READ, TWICE)}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.fates, "input string, path string, fate string")


class _Store:
    """The file system that holds a path, as Hadoop sees it: a local disk, HDFS, an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(self._conf)

    def status(self):
        """The file or folder of exactly this name, if there is one."""
        return self._fs.getFileStatus(self._path) if self._fs.exists(self._path) else None

    def below(self, recursive: bool) -> Iterator:
        """Files of a folder. The names come in portions, however many there are."""
        entries = self._fs.listFiles(self._path, True) if recursive else self._fs.listStatusIterator(self._path)
        while entries.hasNext():
            entry = entries.next()
            if entry.isFile():
                yield entry

    def lines(self, encoding: str):
        """A reader of the file's lines."""
        stream = self._fs.open(self._path)
        codec = self._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self._conf).getCodec(self._path)
        if codec is not None:
            stream = codec.createInputStream(stream)
        java = self._jvm.java.io
        return java.BufferedReader(java.InputStreamReader(stream, encoding))

    def matching(self) -> list:
        return [entry for entry in self._fs.globStatus(self._path) or [] if entry.isFile()]


def _shown(status) -> str:
    """The full path as text, local ones without a scheme."""
    path = status.getPath()
    uri = path.toUri()
    return uri.getPath() if uri.getScheme() in (None, "file") else path.toString()


def _hidden(path: str, above: str = "") -> bool:
    parts = path.removeprefix(above).strip("/").split("/")
    return any(p.startswith(("_", ".")) for p in parts)


@dataclass(frozen=True)
class Head:
    """The first line of a file that is not blank (None if all are), its location and size."""

    line: str | None
    uri: str
    size: int


def read_head(spark: SparkSession, path: str, encoding: str, blanks: str) -> Head:
    """The head of a file, with the lines that a quoted value in it runs on to; nothing behind it is read.

    Opened as Hadoop's readers do, through the file system and codec that belong to its name.
    """
    store = _Store(spark, path)
    status = store.status()
    if status is None or not status.isFile():
        raise FileNotFoundError("there is no such file")
    lines = store.lines(encoding)
    head: list[str] = []
    try:
        while (line := lines.readLine()) is not None:
            line = line if head else line.removeprefix("\ufeff")
            if head or line.strip(blanks):
                head.append(line)
                if sum(x.count('"') for x in head) % 2 == 0:
                    break
    finally:
        lines.close()
    return Head("\n".join(head) if head else None, status.getPath().toUri().toString(), status.getLen())


def _look(spark: SparkSession, item: str, pattern: str, recursive: bool) -> list[tuple[str, str]]:
    """(path, fate) of the files that one input leads to, by name."""
    store = _Store(spark, item)
    status = store.status()
    if status is not None and status.isDirectory():
        above = _shown(status)
        names = sorted(_shown(s) for s in store.below(recursive))
        fits = [p for p in names if fnmatch.fnmatchcase(p.rsplit("/", 1)[1], pattern)]
        return [(p, HIDDEN if _hidden(p, above) else READ) for p in fits]
    names = [_shown(status)] if status is not None else sorted(_shown(s) for s in store.matching())
    out = []
    for path in names:
        name = path.rsplit("/", 1)[1]
        fate = HIDDEN if _hidden(name) else READ if name.lower().endswith(CSV_SUFFIX) else OTHER_SUFFIX
        out.append((path, fate))
    return out


def find_files(
    spark: SparkSession,
    inputs: str | Sequence[str],
    pattern: str = "*.csv",
    recursive: bool = False,
    on_error: str = "skip",
) -> Found:
    """Files named by a list of directories, files and globs, each once, and what became of the rest.

    Inputs keep their order; within a directory or glob, files go by name. The
    pattern is for directories; files and globs must end in ``.csv``. With ``on_error="raise"``
    an input that leads to nothing, or to a file that cannot be read, is an error.
    """
    paths: dict[str, None] = {}
    fates: list[tuple[str, str | None, str]] = []
    for item in [inputs] if isinstance(inputs, str) else inputs:
        seen = _look(spark, item, pattern, recursive)
        fates += [(item, path, TWICE if fate == READ and path in paths else fate) for path, fate in seen] or [(item, None, NOTHING)]
        paths |= {path: None for path, fate in seen if fate == READ}
    found = Found(list(paths), fates)
    if on_error == "raise" and found.skipped:
        raise FileNotFoundError("; ".join(f"{path}: {fate}" for path, fate in found.skipped.items()))
    return found


def discover(
    spark: SparkSession, inputs: str | Sequence[str], pattern: str = "*.csv", recursive: bool = False
) -> list[str]:
    """The paths alone."""
    return find_files(spark, inputs, pattern, recursive).paths
