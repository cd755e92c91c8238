import numpy as np

from rollcall.llm import QUERIES
from rollcall.llm.ann import nearest, usable


def exact(ids, x, queries):
    out = {}
    for i in queries:
        s = x @ x[list(ids).index(i)]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
        out[i] = [ids[k] for k in order]
    return out


def test_recall_and_order(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(ids, x, ids[ids % 20 == 0])
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[q]} & set(want[q])) for q in want)
    assert hit >= 0.9 * 20 * len(want)
    place = {i: k for k, i in enumerate(ids)}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, v, s in found:
            assert abs(s - x[place[q]] @ x[place[v]]) < 1e-12


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (5, [9.0, 9.0]), (6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, []), (None, [1.0, 1.0])]
    df = usable(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, id int"), "vec_id", "embedding")
    assert sorted(r.id for r in df.collect()) == [0, 2, 3, 5]
    got = nearest(df, df.where("id % 20 = 0"), 4, 1).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 5, 9.0), (2, 2, 0.5), (3, 3, 0.5)]
    assert nearest(df.limit(0), df.limit(0), 0, 0).count() == 0


def test_recall_over_several_blocks(spark, monkeypatch):
    from rollcall.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES", 60)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2400, 48))
    df = usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    asked = df.where("id % 20 = 0")
    got = {}
    for r in nearest(df, asked, 2400, 120).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(np.arange(2400), x, range(0, 2400, 20))
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_lengths_are_searched_among_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3 if i % 3 else 5).tolist()) for i in range(0, 200)]
    df = usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    got = {}
    for r in nearest(df, df.where("id % 20 = 0"), 200, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 200, 20))
    for q, found in got.items():
        same = {i for i, v in rows if len(v) == (3 if q % 3 else 5) and i != q}
        assert len(found) == 20 and {v for _, v in found} <= same
