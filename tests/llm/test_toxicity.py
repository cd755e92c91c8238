import random

import numpy as np

from rollcall.llm.toxicity import REJECT, RIDGE, fit, fit_model, score


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 800)
    row, column = [], []
    for i, g in enumerate(grade):
        for c in range(3):
            if rng.random() < (0.9 if c < g else 0.05):
                row.append(i)
                column.append(c)
    w, theta = fit(np.array(row), np.array(column), grade, 3, 4)
    assert (w > 0).all() and (np.diff(theta) > 0).all()


def test_toxic_documents_are_told_from_others(spark, docs):
    rng = random.Random(1)
    bad = ["idiot", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(600):
        text = [f"word{rng.randint(0, 300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)) if i < 400 else (i, None))
    rows += [(1000, None), (1001, ""), (None, "an IDIOT you scumbag moronic"), (1002, "fine"), (1002, "fine")]
    df = docs(rows)
    model = fit_model(df, spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, toxic int, text string"))
    out = score(df, model)
    assert out.columns == [*df.columns, "severity", "grade"]
    got = [(r.doc_id, r.severity) for r in out.collect()]
    assert len(got) == len(rows)
    wrong = sum((s >= REJECT) != (i % 5 == 0) for i, s in got if i is not None and 400 <= i < 600)
    assert wrong <= 6
    assert all(s < REJECT for i, s in got if i in (1000, 1001, 1002))


def test_nothing_to_learn_from(spark, docs):
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    df = docs([(1, "a"), (2, "b"), (3, None)])
    assert fit_model(df, none) is None and fit_model(df, none.limit(0)) is None
    assert {r.severity for r in score(df, None).collect()} == {0.0}
    assert score(docs([]), None).count() == 0


def _loss(x, row, column, grade, n_features):
    """Penalised mean negative log-likelihood, from its definition."""
    w, theta = x[:n_features], x[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_features + 1 :]))))
    scores = np.zeros(len(grade))
    np.add.at(scores, row, w[column])
    total = 0.0
    for s, g in zip(scores, grade, strict=True):
        below = [0.0, *[1 / (1 + np.exp(-(t - s))) for t in theta], 1.0]
        total -= np.log(below[g + 1] - below[g])
    return total / len(grade) + RIDGE / 2 * (w**2).sum()


def test_the_fit_is_a_minimum_of_the_likelihood():
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 4, 200)
    pairs = [(i, c) for i, g in enumerate(grade) for c in range(5) if rng.random() < 0.2 + 0.15 * g * (c < 3)]
    row, column = (np.array(x) for x in zip(*pairs, strict=True))
    w, theta = fit(row, column, grade, 5, 4)
    x = np.concatenate([w, theta[:1], np.log(np.diff(theta))])
    at = _loss(x, row, column, grade, 5)
    slope = [(_loss(x + d, row, column, grade, 5) - _loss(x - d, row, column, grade, 5)) / 2e-4 for d in np.eye(len(x)) * 1e-4]
    assert np.abs(slope).max() < 2e-3
    assert all(_loss(x + rng.normal(0, 0.3, len(x)), row, column, grade, 5) > at for _ in range(20))


def test_rows_of_one_id_are_one_labelled_row(spark, docs):
    rows = [(i, f"good words {i}") for i in range(30)] + [(100 + i, "vile") for i in range(10)] + [(100, "talk")] * 3
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(10)], "doc_id bigint, toxic int")
    model = fit_model(docs(rows), labels)
    again = fit_model(docs(rows, 1), labels)
    assert (model.keys == again.keys).all() and np.allclose(model.weights, again.weights)
    got = {r.doc_id: r.severity for r in score(docs(rows), model).collect()}
    assert got[101] > 0.5 > got[1]
