"""License texts in documents, found by patience alignment.

A template is aligned with a document's words: *anchors* are words that occur once in the text and once in
the template, their longest increasing subsequence (by patience sorting) is matched, and every gap
between two matches is aligned in the same way, where more words are unique; what has no
unique word left is matched from its two ends. *Coverage* is the part of the template's words
that are matched.

Only stretches of a document that can reach the least coverage are aligned: a template's rarer
words must stand there. The stretch begins and ends within a template's length of these words, so long
documents cost no more than short ones. In a stretch every window that holds enough of the template's
words in any order is aligned: for templates of up to ``FINE`` words, every window of up to nearly twice their length
that begins and ends with one of their words; for longer ones windows of their length, somewhat more and nearly twice
as much, that begin an eighth of it apart. A window that fails leaves the others to be tried, and a text that
occurs twice is found twice.

A license may have several texts; ``SPDX-License-Identifier`` lines are among those given here. Templates may also
be a table (license, text) with whole license texts, which is small and read by the driver.

Defined results: null and empty texts have no license; a document may hold several, and one line per
license and place is returned; places do not overlap: the one with most words matched is taken, of equal ones the
one with greater coverage, then the license that comes first by name, then the earlier place; repeated
rows are reported each for itself; tables may be empty; other columns are not read,
whatever their names; templates of no words match nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table

#: Least part of a template that must be covered.
COVERAGE = 0.8
#: Words of a template by which stretches are found: a match must hold one of them.
SEEDS = 6
#: Words of a template up to which windows begin at every word.
FINE = 16
#: Bytes of license texts that go to every task.
TEMPLATE_BYTES = 16 * 1024 * 1024

#: Notices by which licenses are commonly declared (fixed values).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}
#: Licenses that are also declared by their identifier alone (fixed values).
IDENTIFIERS = (
    "0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES = {name: (text,) for name, text in NOTICES.items()}
for _name in IDENTIFIERS:
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), f"SPDX-License-Identifier: {_name}")

Templates = Mapping[str, str | Sequence[str]]

_WORD = re.compile(r"[\w.+-]*\w")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both."""
    matches: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matches.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matches.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        there: dict[str, int] = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        here: dict[str, int] = {}
        for i in range(a0, a1):
            here[a[i]] = -1 if a[i] in here else i
        anchors = [(i, there[w]) for w, i in here.items() if i >= 0 and there.get(w, -1) >= 0]
        anchors.sort()
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            continue
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            if i1 < a1:
                matches.append((i1, j1))
            if i0 + 1 < i1 and j0 + 1 < j1:
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(matches)


class Scanner:
    def __init__(self, templates: Templates, coverage: float):
        self.coverage = coverage
        #: (license, words) of every text that has words.
        self.templates: list[tuple[str, list[str]]] = []
        for name in sorted(templates):
            texts = templates[name]
            self.templates += [(name, w) for text in ([texts] if isinstance(texts, str) else texts) if (w := words(text))]
        held: Counter[str] = Counter(x for _, w in self.templates for x in set(w))
        #: Templates by each word that can lead to them. With as many distinct words missing as are
        #: seeds, less than the least coverage would be left, so one seed at least is in any match.
        self.leads: dict[str, list[int]] = {}
        for i, (_, w) in enumerate(self.templates):
            least = int((1 - coverage) * len(w)) + 1
            rare = sorted(set(w), key=lambda x: (held[x], -len(x), x))[: max(SEEDS, least)]
            for x in rare:
                self.leads.setdefault(x, []).append(i)
        self.maybe = re.compile("|".join(sorted(map(re.escape, self.leads), key=len, reverse=True)) or r"(?!)", re.IGNORECASE)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end), in characters of the text."""
        if not self.maybe.search(text):
            return []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        own = [text[a:z].lower() for a, z in spans]
        hits: dict[int, list[int]] = {}
        for i, w in enumerate(own):
            for template in self.leads.get(w, ()):
                hits.setdefault(template, []).append(i)
        found = []
        for template, at in hits.items():
            name, w = self.templates[template]
            n, begin = len(w), 0
            while begin < len(at):
                end = begin
                while end + 1 < len(at) and at[end + 1] - at[end] <= n:
                    end += 1
                low, high = max(0, at[begin] - n), min(len(own), at[end] + n + 1)
                found += [(a, z, matched, matched / n, name) for a, z, matched in self.stretch(w, own, low, high)]
                begin = end + 1
        kept: list[tuple[int, int, float, str]] = []
        for a, z, _, part, name in sorted(found, key=lambda f: (-f[2], -f[3], f[4], f[0], f[1])):
            if all(z <= b or a >= y for b, y, _, _ in kept):
                kept.append((a, z, part, name))
        return [(name, part, spans[a][0], spans[z - 1][1]) for a, z, part, name in sorted(kept)]

    def stretch(self, template: list[str], own: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
        """(first word, last word + 1, words matched) of all windows of own[low:high] that cover enough of a template."""
        n, want, out = len(template), Counter(template), set()
        least, inside = self.coverage * n, [w in want for w in own[low:high]]
        step = 1 if n <= FINE else max(1, n // 8)
        for begin in range(low, high, step):
            if n <= FINE and not inside[begin - low]:
                continue
            # words of the template that the window holds, in any order
            here: Counter[str] = Counter()
            count = 0
            for end in range(begin + 1, min(high, begin + 2 * n - 1) + 1):
                w = own[end - 1]
                if inside[end - 1 - low]:
                    here[w] += 1
                    count += here[w] <= want[w]
                tried = inside[end - 1 - low] if n <= FINE else end - begin in (n, n + n // 4, 2 * n - 1) or end == high
                if tried and count >= least:
                    matches = align(own[begin:end], template)
                    if len(matches) >= least:
                        out.add((begin + matches[0][0], begin + matches[-1][0] + 1, len(matches)))
                    if len(matches) == n:
                        break
        return sorted(out)


def _texts(templates: Templates | DataFrame, name: str = "license", text: str = "text") -> Templates:
    if not isinstance(templates, DataFrame):
        return templates
    rows = templates.select(F.col(name).cast("string"), F.col(text).cast("string")).where(f"{name} IS NOT NULL AND {text} IS NOT NULL")
    if rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} bytes of license texts")
    out: dict[str, list[str]] = {}
    for row in rows.collect():  # TEMPLATE_BYTES
        out.setdefault(row[0], []).append(row[1])
    return out


def license_scan(
    docs: DataFrame, templates: Templates | DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """(``key``, ``license``, ``coverage``, ``start``, ``end``): license texts found, by character places."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    own = dict(_texts(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own, coverage)
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for hit in scanner.scan(value) if value else ():
                    rows.append(row)
                    out.append(hit)
            name, part, start, end = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(name, pa.string()),
                    pa.array(part, pa.float64()),
                    pa.array(start, pa.int64()),
                    pa.array(end, pa.int64()),
                ],
                names=["key", "license", "coverage", "start", "end"],
            )

    kind = kept.schema["key"].dataType.simpleString()
    found = kept.mapInArrow(run, f"key {kind}, license string, coverage double, start bigint, end bigint")
    return found.withColumnRenamed("key", key)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return license_scan(table(spark, sf_dir, "documents"), TEMPLATES)
