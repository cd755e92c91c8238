"""Nearest neighbours by largest inner product, with collision-counting hashing.

The index of a block of vectors is one sorted array for each of ``PROJECTIONS`` random
directions. A query looks at the window of each array that is centred on its own projection; *virtual
rehashing* widens all windows by the same factor, so no array is built twice. A vector that
lies in at least ``COLLISIONS`` of the windows (its place in each sorted array is
known, so counting is one comparison per array) is a candidate and is verified with its
inner product in double precision. Widening goes on until a query has ``VERIFY`` of
the block as candidates (and ``LEAST`` for each neighbour asked for).

Largest inner product becomes nearest distance by one more component, the square root of ``M^2 - |x|^2``
with the block's largest norm ``M`` (0 for queries), and by queries of unit length.

Vectors are dealt into blocks of about ``BLOCK`` by hash, queries into blocks of ``QUERIES``; a task
indexes one block and answers one block of queries, so no task holds more than that. The best
of all blocks are merged by rank. Equal vectors have equal projections and are found
together, so ties break by id as in an exact search.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of each length are searched among their own; queries are never their own
candidates; repeated ids are vectors of their own, and are no candidates of queries of the
same id; fewer candidates than asked for are all returned; tables may be empty; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table

PROJECTIONS = 64
#: Windows of the PROJECTIONS that must hold a vector.
COLLISIONS = 40
#: Part of a block that is verified for a query.
VERIFY = 0.2
#: Half a window's first width, and the factor by which it widens.
WIDTH, WIDEN = 0.4, 1.2
TRIES = 8
BLOCK = 16_384
QUERIES = 4_096
TOP = 20
#: Candidates of a query in a block, at least, for each neighbour asked for.
LEAST = 16


class Index:
    """Sorted projections of a block of vectors, end to end, and each vector's place in each."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray):
        projected = directions @ vectors.T
        self.lines, self.n = projected.shape
        order = np.argsort(projected, axis=1, kind="stable")
        #: Lies between the arrays, which makes one sorted array of them all.
        self.gap = 4 * float(np.abs(projected).max()) + 4
        self.shift = np.arange(self.lines) * self.gap
        self.values = (np.take_along_axis(projected, order, axis=1) + self.shift[:, None]).ravel()
        kind = np.uint16 if self.n < 1 << 16 else np.uint32
        self.places = np.empty((self.lines, self.n), dtype=kind)
        self.moved, self.inside = np.empty_like(self.places), np.empty(self.places.shape, dtype=bool)
        np.put_along_axis(self.places, order, np.arange(self.n, dtype=kind)[None, :], axis=1)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and length of the window around ``at`` in each array."""
        at, base = np.clip(at, -self.gap / 4, self.gap / 4) + self.shift, np.arange(self.lines) * self.n
        low = np.searchsorted(self.values, at - min(half, self.gap / 4)) - base
        high = np.searchsorted(self.values, at + min(half, self.gap / 4), side="right") - base
        return low, high - low

    def candidates(self, at: np.ndarray, enough: int, half: float) -> tuple[np.ndarray, float]:
        """Vectors that lie in COLLISIONS windows or more, windows being widened until they are
        enough, and half the width that it took."""
        while True:
            low, length = self.windows(at, half)
            kind = self.places.dtype
            # unsigned, so what lies before a window wraps round to large numbers
            np.subtract(self.places, low.astype(kind)[:, None], out=self.moved)
            np.less(self.moved, np.minimum(length, np.iinfo(kind).max).astype(kind)[:, None], out=self.inside)
            found = np.flatnonzero(np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8) >= COLLISIONS)
            if len(found) >= enough or (length == self.n).all():
                return found, half
            half *= WIDEN


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: int, seed: int = 7) -> pd.DataFrame:
    """The ``top`` best of one block for each query: query_id, vec_id, score."""
    norms = np.einsum("ij,ij->i", x, x)
    most = norms.max()
    lifted = np.column_stack([x, np.sqrt(np.maximum(most - norms, 0))]) / np.sqrt(most)
    unit = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
    directions = np.random.default_rng(seed).standard_normal((PROJECTIONS, lifted.shape[1]))
    sought = Index(lifted, directions)
    at = unit @ directions.T
    enough = min(len(ids), max(LEAST * top, int(VERIFY * len(ids))))
    out, tried, begin = [], [], WIDTH
    for i in np.argsort(query_ids, kind="stable"):
        own = query_ids[i]
        place, half = sought.candidates(at[i], enough, begin)
        if len(tried) < TRIES:  # what the first queries took spares the others some steps
            tried.append(half)
            begin = max(WIDTH, min(tried) / WIDEN) if len(tried) == TRIES else WIDTH
        place = place[ids[place] != own]
        scores = x[place] @ q[i]
        best = np.lexsort((ids[place], -scores))[:top]
        out.append((np.full(len(best), own), ids[place][best], scores[best]))
    query_id, vec_id, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def _search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if left.empty or right.empty:
        return empty
    found = search_block(
        left["id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(float), right["id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(float), TOP
    )
    return found


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that can take part, in double precision."""
    v = F.col("v")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)


def nearest(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``TOP`` of ``vectors`` for each of ``queries``.

    Both hold id and v. Each pair of a vector block and a query block is one group: copies
    of either side grow with the number of the other's blocks, which are as large as a task bears.
    """
    blocks, asks = max(1, -(-n_vectors // BLOCK)), max(1, -(-n_queries // QUERIES))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(asks)).cast("int")
    size = F.size("v").alias("n")  # inner products are of vectors of one length
    left = vectors.select("id", "v", size, own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"))
    right = queries.select("id", "v", size, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), asked.alias("ask"))
    found = (
        left.groupBy("n", "block", "ask")
        .cogroup(right.groupBy("n", "block", "ask"))
        .applyInPandas(_search, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= TOP)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    asked = rows.where(F.col("id") % 20 == 0)
    return nearest(rows, asked, rows.count(), asked.count())
