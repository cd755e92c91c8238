"""Token counts of the fields or sections of a document, by token offsets.

Each document is encoded once, as a whole, so counts are those of the text that a model
reads. The tokens' character spans come from their byte lengths and are joined with the
sections' spans by a search in the sorted section starts. A token that crosses a boundary
is allocated by a rule that the caller names:

``start``
    to the section that holds its first character (whole tokens; the default);
``end``
    to the section that holds its last character;
``share``
    to each section by the share of its bytes there.

Defined results: a null field is empty and gets a row with count 0; repeated rows and ids
stay and count each for itself; an empty table gives an empty one; other columns take no
part, whatever their names. A token that is a part of a character (some are a byte or
two of it) belongs where the character does. What lies in no section is reported under the
section null, so the counts of a document always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table
from rollcall.llm.tokens import default_path, encoder

RULES = ("start", "end", "share")


def char_bounds(text: str, data: bytes, at: np.ndarray) -> np.ndarray:
    """Byte places of character places ``at``."""
    if len(data) == len(text):
        return at
    first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(first, len(data))[at]


def allocate(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and of no section. Sections are sorted, do not overlap,
    and are given, as the tokens are, by byte places."""
    token_starts = np.concatenate(([0], token_ends[:-1]))
    total = float(len(token_ends))
    if not len(starts) or not len(token_ends):
        return np.zeros(len(starts)), total
    if rule == "share":
        # bytes before a place, in tokens: straight lines between the tokens' ends
        places = np.concatenate(([0], token_ends))
        counts = np.arange(len(places), dtype=float)
        found = np.interp(ends, places, counts) - np.interp(starts, places, counts)
        return found, total - float(found.sum())
    at = token_starts if rule == "start" else token_ends - 1
    # of sections that start at one place only the last can hold anything
    section = np.searchsorted(starts, at, side="right") - 1
    inside = (section >= 0) & (at < ends[np.maximum(section, 0)])
    found = np.bincount(section[inside], minlength=len(starts)).astype(float)
    return found, total - float(found.sum())


def count_spans(text: str, spans: Sequence[tuple[int, int]], path: str, rule: str) -> tuple[np.ndarray, float]:
    """Token counts of character spans ``[start, end)`` of one text, and of the rest."""
    coder, data = encoder(path), text.encode()
    ends = np.cumsum(coder.n_bytes[coder.ids(text)])
    begin = np.array([s for s, _ in spans], dtype=np.int64)
    finish = np.array([e for _, e in spans], dtype=np.int64)
    if len(data) != len(text):
        heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        if rule != "share":  # a part of a character stands where the character begins
            starts_at = np.concatenate(([0], ends[:-1]))
            if rule == "start":
                moved = heads[np.searchsorted(heads, starts_at, side="right") - 1] if len(starts_at) else starts_at
                ends = np.append(moved[1:], len(data)) if len(moved) else ends
    return allocate(ends, char_bounds(text, data, begin), char_bounds(text, data, finish), rule)


def token_counts(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    path: str,
    rule: str = "start",
    separator: str = "\n",
) -> DataFrame:
    """Tokens per field of each row: ``key``, ``section``, ``start``, ``end``, ``n_tokens``.

    The document is the fields' texts with ``separator`` after each but the last; a
    separator belongs to the field before it. ``start`` and ``end`` are character places
    in that document. ``n_tokens`` is a double, whole unless the rule is ``share``.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    names = list(fields)
    kept = df.select(
        F.col(key).alias("key"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(names)]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(1 + i).to_pylist() for i in range(len(names))]
            for row, parts in enumerate(zip(*columns, strict=True)):
                text = separator.join(parts)
                edges = np.cumsum([len(p) + len(separator) for p in parts])
                edges[-1] = len(text)
                spans = list(zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True))
                found, rest = count_spans(text, spans, path, rule)
                out += [(row, n, s, e, float(c)) for n, (s, e), c in zip(names, spans, found, strict=True)]
                if rest > 1e-9:
                    out.append((row, None, None, None, rest))
            rows, section, start, end, n = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(section, pa.string()),
                    pa.array(start, pa.int64()),
                    pa.array(end, pa.int64()),
                    pa.array(n, pa.float64()),
                ],
                names=["key", "section", "start", "end", "n_tokens"],
            )

    kind = kept.schema["key"].dataType.simpleString()
    schema = f"key {kind}, section string, start bigint, end bigint, n_tokens double"
    return kept.mapInArrow(count, schema).withColumnRenamed("key", key)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the fields source, lang and text of every document."""
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, "doc_id", ["source", "lang", "text"], default_path())
