import random
import re
from collections import Counter, defaultdict

from rollcall.llm import pairs
from rollcall.llm.components import components
from rollcall.llm.minhash import keep_one, near_duplicates
from tests.llm.conftest import prose


def brute(rows):
    """(shingles, smallest id reachable) per id, from full sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for g in s:
            holders[g].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(words, places, seed):
    w = list(words)
    for p in places:
        w[p % len(w)] = f"e{seed}x{p}"
    return " ".join(w)


def table():
    rows = [(i, prose(i, 120)) for i in range(40)]
    base = prose(900, 200).split()
    rows += [(100 + i, edited(base, [i * 13 + j * 37 for j in range(i % 6)], i)) for i in range(60)]  # near copies, 0 to 5 words changed
    chain = prose(901, 160)
    rows += [(200 + i, chain + " " + prose(950 + i, 4 * i)) for i in range(8)]
    rows += [(300 + i, prose(902, 30).upper() if i % 2 else prose(902, 30)) for i in range(30)]  # copies
    rows += [(400 + i, prose(903, 90) + " " + prose(960 + i, 60)) for i in range(40)]  # a shared passage, no copies
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "ONE two"), (505, "one"), (506, "one two three four five")]
    rows += [(507, prose(990, 30000)), (508, prose(990, 30000) + " more"), (509, "a b c d e"), (510, "a\xa0b c d e")]
    return rows


def test_components_are_those_of_all_links(docs):
    rows = table()
    got = {r.doc_id: r for r in near_duplicates(docs(rows)).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_repeated_rows_and_rows_without_an_id(docs):
    text = prose(1, 50)
    rows = [(3, text), (3, text), (2, text), (None, text), (None, text), (7, None), (7, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs(rows)).collect()), key=repr)
    assert got == sorted([(3, 2, False), (3, 2, False), (2, 2, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True)], key=repr)
    out = keep_one(docs(rows))
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([2, None, None, 7], key=repr)
    assert out.columns == docs(rows).columns


def test_ids_with_two_texts_are_judged_by_each(docs):
    one, two = prose(1, 50), prose(2, 60)
    rows = [(2, two), (9, one), (9, two + " end"), (11, one + " end"), (9, one)]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs(rows)).collect())
    assert got == [(2, 2), (9, 2), (9, 9), (9, 9), (11, 9)]
    assert sorted((r.doc_id, r.text) for r in keep_one(docs(rows)).collect()) == [(2, two), (9, one)]


def test_group_that_its_first_centres_leave_in_parts(docs, monkeypatch):
    """Copies far from each other: many lists stay open after their first centre."""
    rng = random.Random(5)
    base = prose(900, 150).split()
    rows = [(i, edited(base, [rng.randrange(150) for _ in range(rng.choice([2, 3, 4, 5, 6]))], i)) for i in range(150)]
    want = brute(rows)
    assert 3 < len(set(want.values())) < 100
    for rounds in (0, 1, 4):
        monkeypatch.setattr(pairs.grouped, "__defaults__", (rounds,))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows)).collect()} == want


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
    assert keep_one(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 500: 500, 501: 500}
