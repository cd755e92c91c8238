import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollcall.llm import ORACLE, QUERIES, pairs
from rollcall.llm.parity import Bands, block_keys, distance, fold, ngram_components, ngram_join, sketch
from tests.conftest import SF_SMALL
from tests.llm.conftest import prose


def shingle_sets(rows, size=4):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    return sets


def links(sets, percent=85):
    holders, out = defaultdict(list), set()
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                out.add((j, i))
        for g in s:
            holders[g].append(i)
    return out


def brute(rows, percent=85):
    """(shingles, smallest id reachable) per id, from full sets."""
    sets = shingle_sets(rows)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links(sets, percent):
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(words, places, seed):
    w = list(words)
    for p in places:
        w[p % len(w)] = f"e{seed}x{p}"
    return " ".join(w)


def texts():
    rng = random.Random(2)
    rows = [(i, prose(i, 120)) for i in range(30)]
    base = prose(900, 200).split()
    rows += [(100 + i, edited(base, [rng.randrange(200) for _ in range(i % 9)], i)) for i in range(90)]  # near copies
    rows += [(200 + i, prose(901, 160) + " " + prose(950 + i, 3 * i)) for i in range(12)]  # a chain that grows
    rows += [(300 + i, prose(902, 30).upper() if i % 2 else prose(902, 30)) for i in range(30)]  # copies
    rows += [(400 + i, prose(903, 90) + " " + prose(960 + i, 30)) for i in range(40)]  # a shared passage, no copies
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "ONE two"), (505, "one"), (506, "one two three four")]
    rows += [(507, prose(990, 30000)), (508, prose(990, 30000) + " more"), (509, "a b c d"), (510, "a\xa0b c d")]
    for n in range(4, 40):  # pairs of small sets on both sides of the limit
        rows += [(1000 + 10 * n + k, prose(2000 + n, n + k)) for k in range(5)]
    return rows


@pytest.mark.parametrize("rounds", [4, 1, 0])
def test_components_are_those_of_all_links(docs, monkeypatch, rounds):
    monkeypatch.setattr(pairs.grouped, "__defaults__", (rounds,))
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs(rows)).collect()}
    assert got == brute(rows)


def test_all_links_between_different_sets(docs):
    rows = [r for r in texts() if r[0] < 300 or r[0] >= 400]
    found, members = ngram_join(docs(rows))
    ids = defaultdict(list)
    for r in members.collect():
        ids[r.node].append(r.doc_id)
    got = {tuple(sorted((x, y))) for r in found.collect() for x in ids[r.a] for y in ids[r.b]}
    sets = shingle_sets(rows)
    assert got == {tuple(sorted(p)) for p in links(sets) if sets[p[0]] != sets[p[1]]}


def test_near_sets_meet_in_a_band_with_more_blocks_than_they_differ_in():
    bands = Bands()
    for a in range(1, 400):
        for b in range(a, 100 * a // 85 + 1):
            common = set(bands.both(a)) & set(bands.both(b))
            assert common
            most = 15 * (a + b) // 185
            assert any(most <= min(bands.differ(a, k), bands.differ(b, k)) for k in common)
            assert all(bands.blocks(k) > max(bands.differ(a, k), bands.differ(b, k)) for k in common)


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(1)
    for n in (5, 80, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)]))
        both = len(np.setxor1d(a, b))
        for bits in (64, 1024, 8192):
            far = distance(sketch(a, bits), sketch(b, bits))
            assert far <= both and (far - both) % 2 == 0
            assert (fold(sketch(a, 8192), bits // 64) == sketch(a, bits)).all()
        assert (block_keys(a, 3, 200) != block_keys(b, 3, 200)).sum() <= both


def test_repeated_rows_ids_with_two_texts_and_rows_without_an_id(docs):
    one, two, other = prose(1, 50), prose(1, 50) + " end", prose(2, 60)
    rows = [(3, one), (3, one), (2, two), (None, one), (7, None), (9, other), (9, two), (11, other), (12, other + " x")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_components(docs(rows)).collect()), key=repr)
    assert got == sorted([(3, 2), (3, 2), (2, 2), (None, None), (7, 7), (9, 9), (9, 2), (11, 9), (12, 9)], key=repr)


def test_empty_tables(docs):
    assert ngram_components(docs([])).count() == 0
    assert ngram_components(docs([(1, None)])).collect()[0].component_id == 1


def test_query_against_sql(spark):
    import duckdb

    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op12_ngram_jaccard_join"](spark, SF_SMALL).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert rows == set(con.execute(ORACLE["op12_ngram_jaccard_join"]).fetchall())
