"""Toxicity by a cumulative-link ordinal regression over sparse text features.

*Features* of a document are which words it holds, and which beginnings of words (four and
five bytes), as hashes; how often does not count. *Grades* run from 0 (not toxic) to
``GRADES - 1``. The model is ``P(grade <= k) = logistic(theta_k - w . x)``: one weight vector ``w`` for
all thresholds ``theta_0 < theta_1 < ...``. A document's *expected severity* is the sum of
``P(grade > k)`` over the thresholds.

The model is fitted on at most ``SAMPLE`` labelled rows (those whose ids hash lowest, so the same ones
each time), from which it keeps the ``FEATURES`` features that depend most on the
label. Every document is scored on all its words.

Labels here say toxic or not. Toxic rows of the sample are graded by thirds of the share of
their words that the sample ties to toxic rows; a table with grades of its own can be
used as it is.

Defined results: null, empty and blank texts have no features and are scored by the thresholds alone;
with no toxic or no other row to learn from, all documents have severity 0; labels that
are null take no part; repeated rows are scored each for itself, and rows of one id are one
labelled row with the words of all of them; rows without an id are scored too; tables may be empty; all columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table
from rollcall.llm.shingles import chunks, words
from rollcall.session import once

GRADES = 4
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8000
#: Features that the model keeps, at most.
FEATURES = 4096
#: A feature must occur in so many rows of the sample.
LEAST_ROWS = 5
PREFIXES = (4, 5)
STEPS = 300
RIDGE = 2e-4
#: Documents of this expected severity or more are rejected.
REJECT = 0.5


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All feature hashes of some texts, and the place of each one's text. Repeats are left in."""
    found, places = [], []
    for n, prefix in enumerate((None, *PREFIXES)):
        hashes, counts = words(texts, prefix)
        found.append((hashes ^ np.uint64(n * 0x5851F42D4C957F2D)) & ~np.uint64(1))
        places.append(np.repeat(np.arange(len(texts)), counts))
    return np.concatenate(found), np.concatenate(places)


@dataclass
class Model:
    """Feature hashes (sorted), their weights, and the thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.low_bits = np.zeros(1 << 16, dtype=bool)
        self.low_bits[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, of the features that the model knows."""
        hashes, place = features(texts)
        maybe = self.low_bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        hashes, place = hashes[maybe], place[maybe]
        at = np.searchsorted(self.keys, hashes)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        pair = np.unique(place[known] * max(len(self.keys), 1) + at[known])
        return pair // max(len(self.keys), 1), pair % max(len(self.keys), 1)

    def severity(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of ``grade > k``, texts x thresholds."""
        text, feature = self.hits(texts)
        score = np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(row: np.ndarray, column: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the whole sample.

    ``row`` and ``column`` are the places of the ones in the feature matrix. Thresholds
    are a first one and the logarithms of the steps to the next, which keeps them in order.
    """
    n = len(grade)
    x = np.zeros(n_features + n_grades - 1)
    x[n_features] = 2.0
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        w, theta = x[:n_features], x[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_features + 1 :]))))
        score = np.bincount(row, weights=w[column], minlength=n)
        below = np.column_stack([_logistic(theta[None, :] - score[:, None]), np.ones(n)])  # P(grade <= k)
        above = np.column_stack([np.zeros(n), below])[np.arange(n), grade]  # P(grade < own)
        own = below[np.arange(n), grade]
        p = np.maximum(own - above, 1e-12)
        d_own, d_above = own * (1 - own) / p, above * (1 - above) / p
        d_score = (d_own - d_above) / n
        d_theta = np.zeros(n_grades - 1)
        np.add.at(d_theta, grade[grade < n_grades - 1], -d_own[grade < n_grades - 1] / n)
        np.add.at(d_theta, grade[grade > 0] - 1, d_above[grade > 0] / n)
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate(
            [
                np.bincount(column, weights=d_score[row], minlength=n_features) + RIDGE * w,
                [tail[0]],
                tail[1:] * np.exp(x[n_features + 1 :]),
            ]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x = x - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_features + 1 :]))))


def _row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, toxic, t) to (k, toxic, f), a row for each feature of a text."""
    for batch in batches:
        for begin, run in chunks(batch.column(2).to_pylist()):
            found, place = features(run)
            order = np.lexsort((found, place))
            found, place = found[order], place[order]
            new = np.concatenate(([True], (found[1:] != found[:-1]) | (place[1:] != place[:-1]))) if len(found) else np.zeros(0, bool)
            at = pa.array(place[new] + begin)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(found[new].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "toxic", "f"])


def _chosen(known: DataFrame, n_rows: int, n_toxic: int) -> DataFrame:
    """(f, lift): the features that depend most on the label, and how much more often each occurs in toxic rows."""
    share, there, bad = n_toxic / n_rows, F.col("there"), F.col("bad")
    z = (bad - there * share) / F.sqrt(there * share * (1 - share) + 1e-9)
    lift = (bad + 0.5) / n_toxic / ((there - bad + 0.5) / (n_rows - n_toxic))
    counted = known.groupBy("f").agg(F.count("*").alias("there"), F.sum("toxic").alias("bad")).where(there >= LEAST_ROWS)
    return counted.orderBy(F.abs(z).desc(), "f").limit(FEATURES).select("f", lift.alias("lift"))


def train(rows: DataFrame, n_grades: int = GRADES) -> Model | None:
    """The model of labelled texts (k, toxic, t); None if they are all of one kind.

    Features are hashed and counted in tasks. What comes to the driver is the label and the kept features of each row,
    so at most ``SAMPLE`` times ``FEATURES`` small numbers however long the texts are.
    """
    # rows that share an id are one: it has the features of all its texts
    known = once(rows.mapInArrow(_row_features, "k string, toxic int, f bigint").distinct())
    own = once(rows.select("k", "toxic").distinct())
    n_rows, n_toxic = own.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n_toxic in (0, n_rows):
        return None
    chosen = _chosen(known, n_rows, n_toxic).toArrow()
    keys, lift = chosen.column(0).to_numpy().view(np.uint64), chosen.column(1).to_numpy()
    if not len(keys):
        return None
    order = np.argsort(keys)
    keys, lift = keys[order], lift[order]
    numbers = rows.sparkSession.createDataFrame([(int(f), i) for i, f in enumerate(keys.view(np.int64))], "f bigint, c int")
    held = known.join(F.broadcast(numbers), "f", "left").groupBy("k").agg(F.count("*").alias("size"), F.collect_list("c").alias("c"))
    none = F.array().cast("array<int>")
    got = own.join(held, "k", "left").orderBy("k").select("toxic", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("c", none).alias("c"))
    got = got.toArrow()  # SAMPLE rows, FEATURES places each
    toxic, size = got.column("toxic").to_numpy().astype(np.int64), got.column("size").to_numpy()
    lists = got.column("c").combine_chunks()
    column = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    # thirds of the toxic rows, by the share of their features that go with toxic rows
    share = np.bincount(row, weights=(lift[column] >= 10).astype(float), minlength=len(toxic)) / np.maximum(size, 1)
    cuts = np.quantile(share[toxic == 1], np.arange(1, n_grades - 1) / (n_grades - 1))
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, share, side="left"), 0).astype(np.int64)
    weights, thresholds = fit(row, column, grade, len(keys), n_grades)
    return Model(keys, weights, thresholds)


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model of at most ``SAMPLE`` labelled documents."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(SAMPLE)
    )
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(ids), "k")
    return train(rows.select(F.col("k").cast("string").alias("k"), "toxic", "t"))


def score(docs: DataFrame, model: Model | None, text: str = "text", severity: str = "severity", grade: str = "grade") -> DataFrame:
    """``docs`` with the expected ``severity`` and the most likely ``grade``."""
    source = docs.select(F.struct("*").alias("row"))
    place = docs.columns.index(text)
    keys = b"" if model is None else model.keys.tobytes()
    weights = b"" if model is None else model.weights.tobytes()
    thresholds = b"" if model is None else model.thresholds.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(np.frombuffer(keys, np.uint64), np.frombuffer(weights), np.frombuffer(thresholds)) if keys else None
        for batch in batches:
            texts = batch.column(0).field(place).cast(pa.string()).to_pylist()
            expected, grades = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int32)
            if own is not None:
                for begin, part in chunks(texts):
                    over = own.severity(part)
                    sure = -np.diff(np.column_stack([np.ones(len(part)), over, np.zeros(len(part))]), axis=1)
                    expected[begin : begin + len(part)] = over.sum(axis=1)
                    grades[begin : begin + len(part)] = sure.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(grades)], names=["row", "severity", "grade"])

    row = source.schema["row"].dataType.simpleString()
    scored = source.mapInArrow(run, f"row {row}, severity double, grade int")
    return scored.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("severity").alias(severity), F.col("grade").alias(grade))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "grade", (F.col("severity") >= REJECT).alias("rejected"))
