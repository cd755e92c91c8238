import random
import re
from itertools import combinations

from rollcall.llm.licenses import COVERAGE, NOTICES, TEMPLATES, Scanner, align, increasing, license_scan, words
from tests.llm.conftest import prose


def test_increasing_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        v = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        got = [v[i] for i in increasing(v)]
        assert all(a < b for a, b in zip(got, got[1:], strict=False))
        best = max((len(c) for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)
        assert len(got) == best


def test_alignment_is_increasing_and_equal():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        m = align(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
    assert align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def test_notices_are_found_where_they_stand(docs):
    mit, gpl = NOTICES["MIT"], NOTICES["GPL-3.0-notice"]
    rows = [
        (1, f"{prose(1, 50)}\n{mit}\n{prose(2, 50)}"),
        (2, f"{mit} {prose(3, 30)} {mit}"),
        (3, gpl.replace("terms", "conditions").upper()),
        (4, prose(4, 20000) + " " + gpl),
        (5, "the license of this work is not stated"),
        (6, None),
        (7, ""),
        (None, mit),
        (8, mit),
        (8, mit),
    ]
    got = license_scan(docs(rows), TEMPLATES).collect()
    text = dict(rows)
    found = sorted(((r.doc_id, r.license) for r in got), key=repr)
    want = [(1, "MIT"), (2, "MIT"), (2, "MIT"), (3, "GPL-3.0-notice"), (4, "GPL-3.0-notice"), (None, "MIT"), (8, "MIT"), (8, "MIT")]
    assert found == sorted(want, key=repr)
    for r in got:
        if r.license == "MIT":
            assert text[r.doc_id][r.start : r.end] == mit.rstrip(".")
    assert license_scan(docs([]), TEMPLATES).count() == 0
    assert license_scan(docs(rows), {"none": ""}).count() == 0


def named(text, templates=TEMPLATES):
    return [(name, round(part, 3), text[a:z]) for name, part, a, z in Scanner(templates, COVERAGE).scan(text)]


def test_a_window_that_fails_does_not_end_the_search():
    cc = "CC BY 4.0, CC BY 4.0, and CC BY 4.0. Licensed under CC BY 4.0."
    assert named(cc) == [("CC-BY-4.0", 1.0, "Licensed under CC BY 4.0")]
    mit = "MIT License, MIT License, the MIT License. Released under the MIT License."
    assert named(mit) == [("MIT", 1.0, "Released under the MIT License")]
    assert named("# SPDX-License-Identifier: MIT\nx = 1") == [("MIT", 1.0, "SPDX-License-Identifier: MIT")]
    assert named("SPDX-License-Identifier: ISC, SPDX-License-Identifier: Zlib") == [
        ("ISC", 1.0, "SPDX-License-Identifier: ISC"), ("Zlib", 1.0, "SPDX-License-Identifier: Zlib"),
    ]


def test_ties_and_overlaps():
    two = {"B": "alpha beta gamma delta", "A": "alpha beta gamma delta", "C": "alpha beta gamma delta omega"}
    assert named("alpha beta gamma delta", two) == [("A", 1.0, "alpha beta gamma delta")]
    assert named("alpha beta gamma delta omega", two) == [("C", 1.0, "alpha beta gamma delta omega")]


def test_all_windows_of_short_texts():
    """What any window of a text covers is found, with as many words matched."""
    rng = random.Random(8)
    template = "one two three two four five six one"
    scanner, want = Scanner({"T": template}, 0.75), words(template)
    for _ in range(400):
        text = [rng.choice([*want, *want, "x", "y"]) for _ in range(rng.randint(0, 22))]
        if rng.random() < 0.5:
            at, copy = rng.randint(0, len(text)), [w if rng.random() < 0.9 else "z" for w in want]
            text[at:at] = copy
        windows = ((i, j) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 2 * len(want) - 1) + 1))
        windows = ((i, j) for i, j in windows if text[i] in want and text[j - 1] in want)
        most = max((len(align(text[i:j], want)) for i, j in windows), default=0)
        found = scanner.scan(" ".join(text))
        assert bool(found) == (most >= 0.75 * len(want)), text
        if found:
            assert max(round(part * len(want)) for _, part, _, _ in found) == most


def test_templates_as_a_table(spark, docs):
    table = spark.createDataFrame([("T", prose(1, 40), 1), ("T", prose(2, 9), 1), (None, "x", 1), ("U", None, 1)], "license string, text string, n int")
    rows = [(1, prose(5, 30) + " " + prose(1, 40)), (2, prose(2, 9).upper()), (3, prose(3, 50))]
    assert sorted((r.doc_id, r.license) for r in license_scan(docs(rows), table).collect()) == [(1, "T"), (2, "T")]
    assert license_scan(docs(rows), table.limit(0)).count() == 0
    assert not re.search(r"\s", "".join(TEMPLATES))


def test_whole_license_text_with_changes():
    rng = random.Random(3)
    text = prose(7, 1500).split()
    copy = [w if rng.random() < 0.95 else "changed" for w in text]
    around = prose(8, 3000)
    found = named(f"{around} {' '.join(copy)} {around}", {"Long": " ".join(text)})
    assert len(found) == 1 and found[0][1] > 0.9
