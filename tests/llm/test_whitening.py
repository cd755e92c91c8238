import math

import numpy as np
import pytest

from rollcall.llm import QUERIES
from rollcall.llm.feast import Inertia, largest, project
from rollcall.llm.whitening import whiten
from tests.conftest import SF_SMALL

SCHEMA = "vec_id bigint, embedding array<float>, x int, n int, dim int, id string"


def spectra():
    rng = np.random.default_rng(4)
    for d in (1, 2, 16, 17, 64):
        yield rng.uniform(0.1, 9, d)
    yield np.ones(40)  # one eigenvalue only
    yield np.repeat([5.0, 2.0, 1.0], [5, 20, 10])
    yield 10.0 ** -np.arange(0, 20, 0.4)
    yield 1 + 1e-9 * np.arange(30)
    yield np.concatenate([rng.uniform(1, 2, 4), np.zeros(20)])
    for _ in range(40):
        yield 10.0 ** rng.uniform(-5, 2, rng.integers(1, 30))


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("case", range(50))
def test_largest_eigenpairs(case):
    values = list(spectra())[case]
    a = matrix(values)
    e, w = largest(a, 16, 1e-12 * values.sum())
    want = np.sort(values)[::-1][: min(16, (values > 1e-12 * values.sum()).sum())]
    assert e.shape == want.shape and np.allclose(e, want, rtol=0, atol=1e-12 * values.max())
    assert np.allclose(w.T @ w, np.eye(len(e)), atol=1e-12) and np.allclose(a @ w, w * e, atol=1e-11 * values.max())


def test_inertia_and_projector():
    values = np.array([0.5, 1.0, 1.0, 3.0, 8.0])
    a = matrix(values)
    assert [Inertia(a).above(s) for s in (0, 0.75, 2, 5, 9)] == [5, 4, 2, 1, 0]
    p = project(a, np.eye(5), 0.75, 2, 64)  # projects onto the pair of equal eigenvalues
    assert np.allclose(p @ p, p, atol=1e-9) and math.isclose(np.trace(p), 2, abs_tol=1e-9)


def brute(rows):
    """Per row: n, exact deviation, whitened columns (up to sign), explained; from (id, vector)."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    fit = [list(v) for v in dict.fromkeys(map(tuple, x))]
    n, d = len(fit), len(x[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in fit])
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    k = min(16, int((e > 1e-12 * e.sum()).sum()))
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    own = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in x])
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    return n, deviation, own @ w / np.sqrt(e), e / np.trace(cov)


def compare(got, rows):
    n, deviation, whitened, explained = brute(rows)
    k = len(explained)
    assert len(got) == k * len(rows) and {r.n for r in got} == {n}
    table = {(r.vec_id, r.component): r for r in got}
    for i, (vec_id, _) in enumerate(rows):
        assert [table[vec_id, c + 1].deviation for c in range(k)] == [deviation[i]] * k
    columns = np.array([[table[i, c + 1].whitened for c in range(k)] for i, _ in rows])
    signs = np.sign((columns * whitened).sum(axis=0))
    assert np.allclose(columns * signs, whitened, atol=1e-7)
    assert np.allclose([table[rows[0][0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-10


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA).repartition(3)


def test_query_against_brute_force(spark):
    source = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in source if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    compare(QUERIES["op11_embedding_whitening"](spark, SF_SMALL).collect(), rows)


def test_nulls_repeats_and_mixed_lengths(spark):
    rng = np.random.default_rng(8)
    long = [(i, [float(c) for c in rng.normal(0, 3, 20)]) for i in range(60)]
    long += [(100 + i, long[0][1]) for i in range(40)]  # one vector that is very common
    short = [(300 + i, [float(c) for c in rng.normal(5, 1, 3)]) for i in range(30)]
    lone = [(400, [1.0] * 7), (401, [1.0] * 7)]  # no variance: no components
    bad = [(500, None), (501, [1.0, None, 2.0]), (502, [float("nan")] * 20), (503, [float("inf")] + [0.0] * 19), (504, []), (505, [-float("inf"), 1.0, 1.0])]
    got = whiten(frame(spark, long + short + lone + bad)).collect()
    compare([r for r in got if r.vec_id < 300], long)
    compare([r for r in got if 300 <= r.vec_id < 400], short)
    assert max(r.vec_id for r in got) < 400


def test_repeated_and_missing_ids(spark):
    rows = [(1, [0.0, 1.0]), (1, [3.0, 1.0]), (None, [0.0, 5.0]), (None, [0.0, 5.0])]
    got = whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0] * 4 + [1] * 4


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 * i, 3e12 - 1e7 * i * i]) for i in range(8)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    n, deviation, _, explained = brute(rows)
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for (i, _), d in zip(rows, deviation, strict=True)}
    assert np.allclose(sorted({r.explained for r in got}, reverse=True)[0], explained[0])


def test_empty_table(spark):
    assert whiten(frame(spark, [])).collect() == []
