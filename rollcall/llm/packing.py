"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

1.  Documents are encoded once; those longer than a sequence are cut, and every full piece
    is a sequence of its own. What is left has lengths below ``capacity``.
2.  These pieces are dealt at random into *problems* of about ``PROBLEM`` pieces, each
    small enough for one task. Every problem is evolved on ``ISLANDS`` islands, that is,
    by tasks with seeds of their own.
3.  An individual is a list of bins (Falkenauer's grouping representation). It begins as
    a best-fit of the pieces, longest first, disturbed differently for each individual.
    *Crossover* puts a random choice of another individual's well-filled bins into it,
    dissolves its own bins that hold a piece twice now, and best-fits the displaced
    pieces, longest first. *Mutation* dissolves some of the emptiest bins. Fitness is the number of bins,
    then the sum of squared fills.
4.  After each of ``EPOCHS`` epochs an island's *elite* migrates to the next island of its problem.
    An island stops early where its best individual needs no more bins than the sum
    of the lengths does.
5.  The bins that the best islands leave underfilled are pooled over all problems, dealt anew and
    packed once more in the same way, so that partly filled bins do not add up
    with the number of problems.

Defined results: null and empty texts are documents of one id (the end mark); repeated rows
and ids are packed each for itself; a text of any length is cut, never dropped; an empty
table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table
from rollcall.llm.tokens import default_path, encoder
from rollcall.session import once

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0
PROBLEM = 2048
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
#: Bins less full than this are pooled and packed once more.
WELL_FILLED = 0.98


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(``uid``, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``) for all pieces.

    ``uid`` numbers the pieces of one run over the input; store the frame before using it twice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        coder = encoder(path)
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[int, int, int, int, int]] = []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = np.append(coder.ids(value or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for n, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    out.append((uid, n, a, z - a, zlib.crc32(ids[a:z])))
                    uid += 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(columns[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[2:]],
                ],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(cut, schema)


class Bins:
    """An individual: which pieces lie in which bin, and how full each bin is."""

    def __init__(self, groups: list[list[int]], fills: list[int]):
        self.groups, self.fills = groups, fills

    @property
    def fitness(self) -> tuple[int, int]:
        return len(self.groups), -sum(f * f for f in self.fills)

    def genome(self, n: int) -> list[int]:
        out = [0] * n
        for b, group in enumerate(self.groups):
            for item in group:
                out[item] = b
        return out


def from_genome(genome: list[int], lengths: list[int]) -> Bins:
    groups: list[list[int]] = [[] for _ in range(max(genome, default=-1) + 1)]
    for item, b in enumerate(genome):
        groups[b].append(item)
    return Bins(groups, [sum(lengths[i] for i in g) for g in groups])


def best_fit(groups: list[list[int]], fills: list[int], loose: list[int], lengths: list[int], capacity: int) -> Bins:
    """Put each loose piece, in the order given, into the bin that it fills best."""
    # free space and bin in one number, sorted
    base = len(groups) + len(loose) + 1
    free = sorted((capacity - f) * base + b for b, f in enumerate(fills) if f < capacity)
    for item in loose:
        length = lengths[item]
        at = bisect_left(free, length * base)
        if at < len(free):
            space, b = divmod(free.pop(at), base)
            groups[b].append(item)
        else:
            space, b = capacity, len(groups)
            groups.append([item])
            fills.append(0)
        fills[b] += length
        if space > length:
            insort(free, (space - length) * base + b)
    return Bins(groups, fills)


def first_individual(lengths: list[int], capacity: int, rng: np.random.Generator, disturb: float) -> Bins:
    size = np.array(lengths, dtype=float) * (1 + disturb * rng.standard_normal(len(lengths)))
    return best_fit([], [], np.argsort(-size, kind="stable").tolist(), lengths, capacity)


def _without(parent: Bins, taken: set[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """The parent's bins that hold nothing taken, and the pieces of the others that are not taken."""
    groups, fills, loose = [], [], []
    for group, fill in zip(parent.groups, parent.fills, strict=True):
        if taken.isdisjoint(group):
            groups.append(list(group))
            fills.append(fill)
        else:
            loose += [i for i in group if i not in taken]
    return groups, fills, loose


def crossover(receiver: Bins, donor: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """The receiver with some of the donor's best-filled bins."""
    order = np.argsort(-np.array(donor.fills), kind="stable")[: max(1, len(donor.fills) // 2)]
    chosen = rng.choice(order, size=max(1, len(order) // 3), replace=False)
    taken = {i for b in chosen for i in donor.groups[b]}
    groups, fills, loose = _without(receiver, taken)
    groups += [list(donor.groups[b]) for b in chosen]
    fills += [donor.fills[b] for b in chosen]
    loose.sort(key=lambda i: -lengths[i])
    return best_fit(groups, fills, loose, lengths, capacity)


def mutate(one: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Dissolve the emptiest bins, and as many at random, and fit their pieces in anew."""
    n = max(1, len(one.groups) // 50)
    gone = {*np.argsort(one.fills, kind="stable")[:n].tolist(), *rng.integers(0, len(one.groups), n).tolist()}
    loose = [i for b in gone for i in one.groups[b]]
    kept = [b for b in range(len(one.groups)) if b not in gone]
    loose.sort(key=lambda i: -lengths[i])
    return best_fit([list(one.groups[b]) for b in kept], [one.fills[b] for b in kept], loose, lengths, capacity)


def evolve(lengths: list[int], elites: list[list[int]], seed: int, capacity: int = CAPACITY) -> list[int]:
    """One epoch of one island: the genome of the best individual found."""
    if not lengths:
        return []
    rng = np.random.default_rng(seed)
    bound = -(-sum(lengths) // capacity)
    population = [from_genome(g, lengths) for g in elites]
    while len(population) < POPULATION:
        population.append(first_individual(lengths, capacity, rng, 0.0 if not population else 0.05 * len(population)))
        if min(p.fitness for p in population)[0] <= bound:
            break
    for _ in range(GENERATIONS):
        population.sort(key=lambda p: p.fitness)
        if len(population[0].groups) <= bound or len(population) < 2:
            break
        half = population[: max(2, len(population) // 2)]
        children = []
        for receiver in half:
            donor = half[int(rng.integers(len(half)))]
            child = crossover(receiver, donor, lengths, capacity, rng)
            children.append(mutate(child, lengths, capacity, rng) if rng.random() < 0.5 else child)
        population = sorted(half + children, key=lambda p: p.fitness)[:POPULATION]
    return min(population, key=lambda p: p.fitness).genome(len(lengths))


def _epoch(epoch: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            genomes = [
                evolve(lengths, [e for e in elites or [] if e], seed=(problem * 31 + island) * 31 + epoch, capacity=capacity)
                for problem, island, lengths, elites in zip(
                    *[batch.column(c).to_pylist() for c in ("problem", "island", "lengths", "elites")], strict=True
                )
            ]
            columns = [batch.column(c) for c in ("problem", "island", "uids", "lengths")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(genomes, pa.list_(pa.int32()))],
                names=["problem", "island", "uids", "lengths", "genome"],
            )

    return run


def pack(items: DataFrame, n_items: int, capacity: int = CAPACITY) -> DataFrame:
    """(``problem``, ``bin``, ``uid``, ``length``, ``fill``) for items (uid, length); evolved now, and stored."""
    spark = items.sparkSession
    problems = max(1, -(-n_items // PROBLEM))
    tasks = min(problems * ISLANDS, 2 * spark.sparkContext.defaultParallelism * max(1, problems // 64))
    # one row for each problem: it holds about PROBLEM pieces, as the deal is by hash
    dealt = (
        items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(problems)).cast("int").alias("problem"))
        .agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("of"))
        .select("problem", F.transform("of", lambda x: x["uid"]).alias("uids"), F.transform("of", lambda x: x["length"].cast("int")).alias("lengths"))
    )
    nobody = F.expr("cast(null as array<array<int>>)")
    state = dealt.select("problem", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "uids", "lengths", nobody.alias("elites"))
    schema = "problem int, island int, uids array<bigint>, lengths array<int>, genome array<int>"
    for epoch in range(EPOCHS):
        spread = state.repartition(tasks, "problem", "island")
        evolved = once(spread.mapInArrow(_epoch(epoch, capacity), schema))
        guests = evolved.select("problem", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("genome").alias("guest"))
        state = evolved.join(guests, ["problem", "island"]).select(
            "problem", "island", "uids", "lengths", F.array("genome", "guest").alias("elites")
        )
    best = evolved.groupBy("problem").agg(F.min(F.struct(F.array_max("genome").alias("last"), "island")).alias("b"))
    won = evolved.join(best.select("problem", "b.island"), ["problem", "island"]).select(
        "problem", F.explode(F.arrays_zip("uids", "lengths", F.col("genome").alias("bin"))).alias("x")
    )
    return once(won.select("problem", "x.bin", F.col("x.uids").alias("uid"), F.col("x.lengths").cast("bigint").alias("length")))


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """A row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. Sequence ids are unique but not gapless."""
    cut = once(pieces(docs, key, text, path, capacity))
    whole = cut.where(F.col("length") == capacity).select("uid", F.lit(0).alias("offset"), F.lit(0).alias("round"), F.col("uid").alias("sequence"))
    items = cut.where(F.col("length") < capacity).select("uid", "length")
    first = pack(items, items.count(), capacity)
    fills = first.groupBy("problem", "bin").agg(F.sum("length").alias("fill"))
    poor = fills.where(F.col("fill") < WELL_FILLED * capacity).select("problem", "bin")
    again = once(first.join(poor, ["problem", "bin"], "left_semi").select("uid", "length"))
    second = pack(again, again.count(), capacity)
    packed = first.join(poor, ["problem", "bin"], "left_anti").withColumn("round", F.lit(1)).unionByName(
        second.withColumn("round", F.lit(2))
    )
    before = Window.partitionBy("round", "problem", "bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = packed.select(
        "uid",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        "round",
        (F.col("problem").cast("bigint") * (1 << 24) + F.col("bin")).alias("sequence"),
    ).unionByName(whole)
    # the round in the lowest digits keeps the three kinds of sequences apart
    return cut.join(placed, "uid").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") * 3 + F.col("round")).alias("sequence_id"),
        F.col("offset").cast("bigint").alias("offset"),
    )


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), default_path())
