"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1.  Every document gets its distinct word shingles (hashed), a signature of ``K`` minima,
    and a digest of the set. Documents of one set are a class; one row stands for it.
2.  A class is posted under each (coordinate, value) pair of its signature. Pairs that only one
    class has can match nothing and are dropped, and so is a class with fewer than
    ``MATCHES`` pairs left.
3.  *Prefix*: two signatures that agree in ``MATCHES`` places must share one of the
    rarest ``m - MATCHES + 1`` pairs of either, so only these are posted. *Skip*: the long lists
    of frequent pairs are never merged; collisions there are counted on the signatures.
4.  Posting lists are worked off in rounds through centres (``pairs``), so a group of near copies costs a few
    pairs a member and not all its pairs. Classes in the middle of such a group, which share the most
    pairs, become centres first. Every pair that meets has its collisions counted and goes
    on from ``MATCHES``; in the last step a longer sketch is asked before, of parities or of one bit per minimum.
5.  Pairs that pass are confirmed on their full shingle sets, exactly.

A pair at the least similarity fails the screens (``MATCHES`` equal coordinates, and for long texts in the last step
``LEAST_BITS`` equal bits too) with a probability below ``MISS`` each, 1e-6 together; more similar pairs are safer still.
Sets are held as 64-bit hashes, and two different sets pass for one class with a chance below 1e-20 a pair.

Defined results: null and empty texts, and texts of blanks, have no shingles and are linked
with nothing; repeated rows are copies of each other; rows that share an id and
differ in text are judged each by its own text; a row without an id takes no part (no component, kept); an empty
table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.ids import sized, without
from rollcall.llm.pairs import Sets, confirmer, far_bits, grouped, may_differ, sides
from rollcall.llm.parity import sketch
from rollcall.llm.registry import query, table
from rollcall.llm.shingles import chunks, shingles, signatures
from rollcall.session import once

K = 128
#: Least similarity, in hundredths, so that it is compared in whole numbers.
SIMILARITY = 75
MISS = 5e-7
WORDS = 5
#: Bits of the sketches by which the last pairs are screened. Sets of up to ``FEW`` shingles are compared by the parities
#: of their shingles, which loses no pair; for larger ones there are too few bits, and one from each of as many minima is used.
BITS, FEW = 1024, 1000


def least_matches(k: int, similarity: float, miss: float) -> int:
    """The largest threshold below which a pair at ``similarity`` falls with chance ``miss`` at most."""
    p, below, m = similarity / 100, 0.0, 0
    while below + (term := comb(k, m) * p**m * (1 - p) ** (k - m)) <= miss:
        below, m = below + term, m + 1
    return m


MATCHES = least_matches(K, SIMILARITY, MISS)
#: Two minima that differ have equal last bits half of the time.
LEAST_BITS = least_matches(BITS, (100 + SIMILARITY) / 2, MISS)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, text hash ``h``, ``n_shingles``, set digest ``d1``/``d2``, ``sig`` (null without shingles)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, one, two, sigs = [], [], [], []
            for _, run in chunks(texts):
                hashes, n = shingles(run, WORDS)
                some = n > 0
                sig = np.zeros((len(run), K), dtype=np.uint32)
                if some.any():
                    sig[some] = signatures(hashes, n[some], K)
                sigs.append(sig)
                for part in np.split(hashes, np.cumsum(n)[:-1]):
                    kept = np.unique(part)
                    sizes.append(len(kept))
                    one.append(np.add.reduce(kept) if len(kept) else np.uint64(0))
                    two.append(np.bitwise_xor.reduce((kept >> np.uint64(7)) * kept) if len(kept) else np.uint64(0))
            n_rows = len(texts)
            flat = np.concatenate(sigs).view(np.int32) if sigs else np.zeros((0, K), np.int32)
            missing = pa.array(np.array(sizes, dtype=np.int64) == 0) if sizes else pa.array([], pa.bool_())
            offsets = pa.array(np.arange(n_rows + 1, dtype=np.int32) * K)
            sig_array = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()), mask=missing) if n_rows else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                    sig_array,
                ],
                names=["id", "h", "n_shingles", "d1", "d2", "sig"],
            )

    return _rows(docs, key, text).mapInArrow(sketch, "id bigint, h bigint, n_shingles bigint, d1 bigint, d2 bigint, sig array<int>")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.select("id", F.xxhash64("text").alias("h"), "text")


def _sig(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, K)


def _count_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) to (a, b, matches)."""
    for batch in batches:
        if batch.num_rows:
            equal = (_sig(batch.column(2)) == _sig(batch.column(3))).sum(axis=1)
            near = pa.array(equal >= MATCHES)
            columns = [batch.column(0), batch.column(1), pa.array(equal, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in columns], names=["a", "b", "matches"])


def _sketch_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, bits, start): the parity sketch, then the last bits of the minima, and which one to begin with."""
    for batch in batches:
        out, start = [], []
        for _, run in chunks(batch.column(1).to_pylist()):
            hashes, n = shingles(run, WORDS)
            last = np.packbits((signatures(hashes, n, BITS) & 1).astype(np.uint8), axis=1).view(np.int64)
            for minima, part in zip(last.tolist(), np.split(hashes, np.cumsum(n)[:-1]), strict=True):
                own = np.unique(part)
                out.append(sketch(own, BITS).tolist() + minima)
                start.append(0 if len(own) <= FEW else BITS // 64)
        columns = [batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(start, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "bits", "start"])


def postings(classes: DataFrame) -> DataFrame:
    """(tok, node, n, weight): the rarest coordinate-value pairs of each class. ``weight`` counts how often
    all its pairs are posted."""
    posted = classes.select("node", "n", F.posexplode("sig").alias("j", "v")).select(
        "node", "n", (F.shiftleft(F.col("j").cast("bigint"), 32) + F.col("v").cast("bigint") + F.lit(1 << 31)).alias("tok")
    )
    shared = once(posted.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))
    own = (
        posted.join(shared, "tok")  # as large as the corpus: never broadcast; stored, so that hot pairs are split
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"), F.sum("df").alias("weight"))  # K at most
        .where(F.size("toks") >= MATCHES)
    )
    prefix = F.slice("toks", F.lit(1), F.size("toks") - (MATCHES - 1))
    return own.select(F.explode(F.transform(prefix, lambda t: t["tok"])).alias("tok"), "node", "n", "weight")


def linked(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the classes that have links.

    ``classes``: node, n, sig. ``texts``: node, text.
    """
    posted = once(postings(classes))
    chosen = sized(posted.select("node").distinct())
    texts = once(texts.join(chosen, "node", "left_semi"))
    sigs = once(classes.select("node", "sig").join(chosen, "node", "left_semi"))

    def check(pairs: DataFrame) -> DataFrame:
        matched = sides(pairs, sigs, "sig").mapInArrow(_count_matches, "a bigint, b bigint, matches int")
        return sides(matched.select("a", "b"), texts, "text").mapInArrow(confirmer(WORDS, SIMILARITY), "a bigint, b bigint")

    def bits(nodes: DataFrame) -> DataFrame:
        return texts.join(sized(nodes), "node", "left_semi").mapInArrow(_sketch_bits, "node bigint, bits array<bigint>, start int")

    limit = F.when(F.col("start_a") == 0, may_differ(SIMILARITY)).otherwise(BITS - LEAST_BITS)
    return grouped(posted, SIMILARITY, check, bits, far_bits(BITS // 64, F.col("start_a")) <= limit)


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    sketched = once(sketches(docs, key, text))
    sets = Sets(sketched)
    classes = sets.firsts(sketched.select("id", "h", F.col("n_shingles").alias("n"), "sig"))
    return sets.component_ids(linked(classes, sets.firsts(_rows(docs, key, text))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``."""
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))
    return _found(docs, key, text).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, and of
    repeated rows one. Rows without an id stay."""
    found = once(_found(docs, key, text).where("id IS NOT NULL").select("id", "h", F.coalesce("first", F.lit(True)).alias("stays")))
    by_id = found.groupBy("id").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n"))
    out = without(docs, by_id.where("NOT stays").select("id"), key)
    twice = once(by_id.where("stays AND n > 1").select("id"))
    if twice.isEmpty():
        return out
    texts = found.where("stays").join(twice, "id").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    rest = out.join(twice.select(F.col("id").alias(key)), key, "left_anti").select(*docs.columns)
    same = (F.col("_id") == out[key]) & (F.col("_h") == F.xxhash64(out[text].cast("string")))
    return rest.unionByName(out.join(texts, same, "left_semi").dropDuplicates([key, text]))


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
