"""Whitening of embeddings by the leading components of their covariance.

1.  Entries become whole numbers (``SCALE`` steps a unit, ``OFFSET`` added), so that every sum
    is exact and does not depend on how rows are dealt.
2.  Equal vectors count once: the fit list. One pass over it sums the entries; the next takes the whole
    number nearest to each mean off and sums entries and products, as partial matrices in
    Arrow tasks that Spark adds up. The covariance is worked out from these without rounding.
3.  The leading eigenpairs come from FEAST contour integration (``feast``), in one task per
    length of vector, which holds a matrix of that length squared, however many rows there are.
4.  The fit list is whitened once to measure how far its covariance is from the identity; then all
    rows are.

Defined results: vectors that are null or hold null or non-finite entries are left out; whole numbers beyond
2^53 either way count as 2^53; vectors of each length are fitted among their own; empty vectors,
and lists without any variance, have no components; components without variance (below ``LEAST`` of
the trace) are left out; a deviation beyond 64 bits is null; repeated ids and rows without an id are rows of
their own; tables may be empty; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.feast import largest
from rollcall.llm.registry import query, table
from rollcall.session import once

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Part of the trace below which an eigenvalue is no variance but rounding.
LEAST = 1e-12
BOUND = 1 << 53
#: Numbers of fitted models that go along with the tasks of one pass; more lengths take more passes.
MODEL_NUMBERS = 4_000_000


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): the usable vectors in whole numbers."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bound = F.lit(BOUND).cast("double")
    usable = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform("v", lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, -bound), bound)), F.lit(-BOUND)), F.lit(BOUND)) + offset)
    return rows.where(usable).select("id", whole.alias("x"))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Y'Y in whole numbers of any size."""
    d, most = y.shape[1], int(np.abs(y).max(initial=0))
    out = np.zeros((d, d), dtype=object)
    if most >= 1 << 26:
        wide = y.astype(object)
        return out + wide.T @ wide
    rows = max(1, (1 << 53) // max(most * most, 1))
    for i in range(0, len(y), rows):  # every sum is a whole number that a double holds
        part = y[i : i + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _exact_sums(y: np.ndarray) -> np.ndarray:
    safe = int(np.abs(y).max(initial=0)) * len(y) < 1 << 62
    return y.sum(axis=0).astype(object) if safe else y.astype(object).sum(axis=0)


Sums = Callable[[np.ndarray], np.ndarray]


def _partial(sums: Callable[[int], Sums], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(x) to (dim, n, values): what ``sums`` of the length makes of the vectors, added up over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for at, x in _by_length(batch.column(0)):
                part = sums(x.shape[1])(x)
                known = total.setdefault(x.shape[1], [0, np.zeros_like(part)])
                known[0] += len(at)
                known[1] = known[1] + part
        for d, (n, values) in total.items():
            columns = [pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([values.tolist()], pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "values"])

    return run


def _added(fit: DataFrame, sums: Callable[[int], Sums], exact: bool) -> DataFrame:
    """(dim, n, values) over the whole fit list."""
    kind, name = (pa.decimal128(38, 0), "decimal(38,0)") if exact else (pa.float64(), "double")
    partial = once(fit.select("x").mapInArrow(_partial(sums, kind), f"dim int, n bigint, values array<{name}>"))
    entries = partial.select("dim", F.posexplode("values").alias("at", "value")).groupBy("dim", "at").agg(F.sum("value").alias("value"))
    values = entries.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("l"))  # a matrix
    return partial.groupBy("dim").agg(F.sum("n").alias("n")).join(values.select("dim", F.col("l.value").alias("values")), "dim")


def _solver(components: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        d, n = int(rows["dim"].iloc[0]), int(rows["n"].iloc[0])
        values = [int(v) for v in rows["values"].iloc[0]]
        s, upper = values[:d], values[d:]
        v, at = np.empty((d, d)), 0
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (n * upper[at] - s[i] * s[j]) / (n * n)
                at += 1
        trace = float(np.trace(v))
        e, w = largest(v, components, LEAST * trace) if trace > 0 else (np.empty(0), np.empty((d, 0)))
        return pd.DataFrame({"dim": [d], "n": [n], "sums": [s], "e": [e.tolist()], "w": [w.T.ravel().tolist()], "explained": [(e / trace).tolist() if trace else []]})

    return solve


class Model:
    """Components of the vectors of one length."""

    def __init__(self, n: int, centre: list[int], sums: list[int], e: list[float], w: list[float], explained: list[float]):
        self.n, self.explained = n, np.array(explained)
        self.centre, self.sums = np.array(centre, dtype=np.int64), np.array(sums, dtype=np.int64)
        self.directions = np.array(w).reshape(len(e), len(centre)) / np.sqrt(np.array(e))[:, None]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A row per vector, a column per component."""
        return ((x - self.centre) - self.sums / self.n) @ self.directions.T

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        y = x - self.centre
        rough = ((self.n * y.astype(np.float64) - self.sums) ** 2).sum(axis=1)
        fits = rough < float(1 << 62)
        out = [None] * len(y)
        for i, v in zip(np.flatnonzero(fits), ((self.n * y[fits] - self.sums) ** 2).sum(axis=1).tolist(), strict=True):
            out[i] = v
        for i in np.flatnonzero(~fits & (rough < 1e19)):
            exact = sum((self.n * int(a) - int(s)) ** 2 for a, s in zip(y[i], self.sums, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return pa.array(out, pa.int64())


def _lengths(fit: DataFrame, components: int) -> Iterator[dict[int, list[int]]]:
    """The whole number nearest to each mean, for the lengths of one pass after the other."""
    sums = once(_added(fit, lambda d: _exact_sums, exact=True))
    chunk, size = {}, 0
    for row in sums.toLocalIterator():
        if chunk and size + row.dim * (components + 4) > MODEL_NUMBERS:
            yield chunk
            chunk, size = {}, 0
        chunk[row.dim] = [(2 * int(s) + row.n) // (2 * row.n) for s in row["values"]]
        size += row.dim * (components + 4)
    if chunk:
        yield chunk


def fit_models(fit: DataFrame, centres: dict[int, list[int]], components: int = COMPONENTS) -> dict[int, Model]:
    """Models of the lengths in ``centres``."""

    def products(d: int) -> Sums:
        centre = np.array(centres[d], dtype=np.int64)

        def both(x: np.ndarray) -> np.ndarray:
            y = x - centre
            return np.concatenate([_exact_sums(y), _exact_products(y)[np.triu_indices(d)]])

        return both

    solved = _added(fit, products, exact=True).groupBy("dim").applyInPandas(
        _solver(components), "dim int, n bigint, sums array<bigint>, e array<double>, w array<double>, explained array<double>"
    )
    return {r.dim: Model(r.n, centres[r.dim], r.sums, r.e, r.w, r.explained) for r in once(solved).collect()}  # MODEL_NUMBERS


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per length, the largest absolute entry of the whitened fit list's covariance less the identity."""

    def products(d: int) -> Sums:
        def both(x: np.ndarray) -> np.ndarray:
            w = models[d].whiten(x)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        return both

    out = {}
    for row in _added(fit, products, exact=False).collect():  # a few hundred numbers a length
        k = len(models[row.dim].explained)
        mean, square = np.array(row["values"][:k]) / row.n, np.array(row["values"][k:]).reshape(k, k) / row.n
        out[row.dim] = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``."""
    rows = integer_vectors(df, key, vector).where(F.size("x") > 0)
    fit = once(rows.select("x").distinct())
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    parts = []
    for centres in _lengths(fit, components):
        some = F.size("x").isin(*centres)
        models = fit_models(fit.where(some), centres, components)
        models = {d: m for d, m in models.items() if len(m.explained)}
        if not models:
            continue
        errors = identity_errors(fit.where(F.size("x").isin(*models)), models)
        parts.append(rows.where(F.size("x").isin(*models)).mapInArrow(_whitener(models, errors), schema))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def _whitener(models: dict[int, Model], errors: dict[int, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column(1)):
                m = models[x.shape[1]]
                k, rows = len(m.explained), len(at)
                each = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n, dtype=np.int64)),
                    m.deviation(x).take(each),
                    pa.array(m.whiten(x).ravel()),
                    pa.array(np.tile(m.explained, rows)),
                    pa.array(np.full(rows * k, errors[x.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the leading components of their covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))
