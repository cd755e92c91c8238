"""Connected components of a link table, as rounds of joins and groupings.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every step links nodes to the smallest node seen near them,
so chains and stars alike shrink in a logarithmic number of rounds. A node with very
many links never meets them in one task: minima are grouped map-side, stored, and joined back by
a join that adaptive execution can split at such a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import once


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` for every node of ``links``; the component is its smallest node.

    Links are undirected; repeated links, links of a node to itself and nulls change
    nothing. Each round is a table in the shared folder, so that plans stay short and a
    lost executor costs one round.
    """
    edges = once(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    )
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        near = _both(edges)
        low = once(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest
        large = once(large)
        low = once(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = once(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
