import zlib
from collections import defaultdict

import numpy as np

from rollcall.llm.packing import CAPACITY, best_fit, crossover, evolve, first_individual, from_genome, pack_documents
from rollcall.llm.tokens import default_path, encoder
from tests.llm.conftest import prose


def test_evolution_keeps_every_piece_once_and_nears_the_bound():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 600).tolist()
    genome = evolve(lengths, [], 1)
    again = evolve(lengths, [genome], 2)
    for g in (genome, again):
        bins = from_genome(g, lengths)
        assert sorted(i for b in bins.groups for i in b) == list(range(600))
        assert max(bins.fills) <= CAPACITY
    bound = -(-sum(lengths) // CAPACITY)
    assert max(again) <= max(genome) and max(again) + 1 <= first_bins(lengths) and max(again) + 1 >= bound


def first_bins(lengths):
    return len(first_individual(lengths, CAPACITY, np.random.default_rng(0), 0.0).groups)


def test_crossover_drops_repeats_and_refits():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 200).tolist()
    a, b = first_individual(lengths, CAPACITY, rng, 0.1), first_individual(lengths, CAPACITY, rng, 0.4)
    child = crossover(a, b, lengths, CAPACITY, rng)
    assert sorted(i for g in child.groups for i in g) == list(range(200)) and max(child.fills) <= CAPACITY
    tight = best_fit([[0], [1]], [2000, 1000], [2], [2000, 1000, 48], CAPACITY)
    assert tight.groups == [[0, 2], [1]]
    assert evolve([], [], 0) == [] and evolve([5], [], 0) == [0]


def test_pieces_and_sequences(docs):
    rows = [(i, prose(i, 20 + 37 * i)) for i in range(60)] + [(100, None), (101, ""), (102, prose(5, 9000)), (None, "x"), (7, "again"), (7, "again")]
    got = pack_documents(docs(rows), default_path()).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.append(encoder(default_path()).ids(t or ""), 0).astype("<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.length == CAPACITY or r.piece == 0
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // CAPACITY) + 1


def test_empty_table(docs):
    assert pack_documents(docs([]), default_path()).count() == 0
