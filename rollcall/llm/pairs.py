"""Groups of similar texts from posting lists, without all pairs of a list.

A posting list holds the nodes that share some key; nodes that are similar enough share a list at
least. What is wanted is not every link but the groups that all links make. So lists are first worked
off in rounds: in each, every list that still holds nodes of several groups names a centre, and every node
meets the most central one of those that its lists name, if it is of another group. What is confirmed
joins groups. A group of L near copies costs L pairs a round, and lists that hold one group are done.
After ``ROUNDS`` rounds, what is left outside the largest group of a list meets the nodes of its other
groups, behind a filter that is evaluated inside the join. As that step forms all pairs of a list
between different groups, no link that could join two groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.components import components
from rollcall.llm.ids import sized
from rollcall.llm.shingles import chunks, shingles
from rollcall.operators.joins import join_small
from rollcall.session import once

#: Rounds through centres before the remaining pairs are formed.
ROUNDS = 4

Frames = Callable[[DataFrame], DataFrame]


class Sets:
    """The distinct shingle sets of a table: a node for each, and the first document that has it.

    ``documents``: (id, h, n_shingles, d1, d2, ...), stored; ``h`` tells texts of one id apart. Rows
    without shingles or without an id have no node. Equal sets are told by size and 128-bit digest.
    """

    def __init__(self, documents: DataFrame):
        self.documents = documents
        linkable = documents.where("n_shingles > 0 AND id IS NOT NULL")
        sets = linkable.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("id", "h")).alias("first"))
        self.sets = once(sets.withColumn("node", F.monotonically_increasing_id()))
        self._firsts = sized(self.sets.select("first.id", "first.h", "node"))
        self._repeated = not linkable.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def firsts(self, rows: DataFrame) -> DataFrame:
        """The rows (id, h, ...) of first documents, one for each node."""
        found = rows.join(self._firsts, ["id", "h"]).drop("id", "h")
        return found.dropDuplicates(["node"]) if self._repeated else found

    def component_ids(self, components: DataFrame) -> DataFrame:
        """(id, h, n_shingles, component_id, first) of every document, from (node, component) of the nodes that have
        links. ``first`` marks the document that stands for its component; null without a node."""
        named = self.sets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        # a component may hold a third of all sets: its least id is aggregated, stored, and joined by size
        named = join_small(named, once(least), ["component"]).select("n_shingles", "d1", "d2", "least")
        own = F.when(F.col("id").isNotNull(), F.col("least"))
        found = join_small(self.documents.select("id", "h", "n_shingles", "d1", "d2"), once(named), ["n_shingles", "d1", "d2"], "left")
        return found.select(
            "id", "h", "n_shingles", F.coalesce(own["id"], "id").alias("component_id"), (own == F.struct("id", "h")).alias("first")
        )


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Sets of such sizes can be near enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def sides(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """(a, b, value of a, value of b)."""
    a = of.select(F.col("node").alias("a"), F.col(value).alias(f"{value}_a"))
    b = of.select(F.col("node").alias("b"), F.col(value).alias(f"{value}_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", f"{value}_a", f"{value}_b")


def confirmer(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, text_a, text_b) to (a, b) of those whose full sets are near enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            both = [t for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for t in pair]
            left = None
            for _, run in chunks(both):
                hashes, n = shingles(run, words)
                for part in np.split(hashes, np.cumsum(n)[:-1]):
                    own = np.unique(part)
                    if left is None:
                        left = own
                        continue
                    shared = len(np.intersect1d(left, own, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(left) + len(own) - shared))
                    left = None
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return confirm


def far_bits(longs: int, start: Column | None = None) -> Column:
    """Bits in which the arrays ``bits_a`` and ``bits`` of a pair differ, over ``longs`` numbers from ``start`` on."""
    places = [F.lit(i) if start is None else start + i for i in range(longs)]
    return reduce(Column.__add__, [F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits", i))) for i in places])


def may_differ(percent: int) -> Column:
    """Most shingles that are not in both of two near sets, whose sizes are ``n_a`` and ``n``."""
    return F.floor((F.col("n_a") + F.col("n")) * (100 - percent) / (100 + percent))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after ``links`` have joined groups; nodes that are not there are their own group."""
    if labels is None:
        return once(components(links).select("node", F.col("component").alias("label")))
    old = once(labels)
    named = links
    for side in ("a", "b"):
        mine = old.select(F.col("node").alias(side), F.col("label").alias("l"))
        named = named.join(mine, side, "left").withColumn(side, F.coalesce("l", side)).drop("l")
    joined = components(named).select(F.col("node").alias("label"), "component")
    moved = old.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    fresh = joined.select(F.col("label").alias("node"), F.col("component").alias("label")).join(old.select("node"), "node", "left_anti")
    return once(moved.unionByName(fresh))


def grouped(posted: DataFrame, percent: int, check: Frames, bits: Frames, near: Column, rounds: int = ROUNDS) -> DataFrame:
    """``node``, ``component`` for the nodes that have links; the component is the smallest node.

    ``posted``: (tok, node, n, weight), stored. Nodes of great ``weight`` become centres first. ``check``
    turns pairs (a, b) into links. ``bits``: (node) to (node, bits, ...), by which ``near`` (over ``bits_a``, ``n_a``, ... of
    one and ``bits``, ``n``, ... of the other) screens the pairs of the last step. It is evaluated for very many
    pairs: keep it short enough for the JVM to compile.
    """
    # the hash settles ties alike everywhere
    order = F.struct(F.col("weight"), F.xxhash64("node").alias("h"), F.col("node"))
    lists = posted.groupBy("tok").agg(F.count("*").alias("members")).where("members > 1")
    lists = once(lists.select("tok", F.lit(None).cast("struct<weight:bigint,h:bigint,node:bigint>").alias("bound")))
    labels = None
    for _ in range(rounds):
        now = _open(posted, lists, labels)
        candidate = F.when(F.col("bound").isNull() | (order < F.col("bound")), F.struct(order.alias("o"), "n", "label"))
        lists = now.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(candidate).alias("c"))
        lists = once(lists.where("low <> high").select("tok", F.col("c.o").alias("bound"), "c"))
        if lists.isEmpty():
            return _named(posted, labels)
        met = join_small(_labelled(posted, labels), lists.select("tok", "c").where("c IS NOT NULL"), ["tok"])
        met = met.where((F.col("label") != F.col("c.label")) & sizes_fit(F.col("n"), F.col("c.n"), percent))
        # a node meets the most central of the centres that its lists name
        pairs = met.groupBy(F.col("node").alias("a")).agg(F.max("c.o").alias("o")).select("a", F.col("o.node").alias("b"))
        links = once(check(pairs))
        if not links.isEmpty():
            labels = _relabelled(labels, links)
        lists = lists.select("tok", "bound")
    links = once(check(_rest(_open(posted, lists, labels), percent, bits, near)))
    return _named(posted, labels if links.isEmpty() else _relabelled(labels, links))


def _named(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posted.select("node", F.col("node").alias("component")).limit(0)
    return labels.select("node", F.col("label").alias("component"))


def _labelled(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posted.withColumn("label", F.col("node"))
    return join_small(posted, labels, ["node"], "left").withColumn("label", F.coalesce("label", "node"))


def _open(posted: DataFrame, lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The nodes of the given lists, with their groups."""
    return _labelled(join_small(posted, lists.select("tok", "bound"), ["tok"]), labels)


def _rest(now: DataFrame, percent: int, bits: Frames, near: Column) -> DataFrame:
    """Pairs between the nodes outside a list's largest group and those of its other groups."""
    now = once(now.select("tok", "node", "n", "label"))
    sizes = now.groupBy("tok", "label").agg(F.count("*").alias("members"))
    main = sizes.groupBy("tok").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("labels"))
    main = once(main.where("labels > 1").drop("labels"))
    now = once(join_small(now, main, ["tok"]))
    known = once(bits(now.select("node").distinct()))
    members = join_small(now, known, ["node"])
    others = members.where("label <> main").select("tok", *[F.col(c).alias(f"{c}_a") for c in members.columns if c not in ("tok", "main")])
    apart = (F.col("label") != F.col("label_a")) & ((F.col("label") == F.col("main")) | (F.col("node_a") < F.col("node")))
    met = others.join(
        members.withColumnRenamed("tok", "tok_b"),
        (F.col("tok") == F.col("tok_b")) & apart & sizes_fit(F.col("n_a"), F.col("n"), percent) & near,
    )
    return met.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()
