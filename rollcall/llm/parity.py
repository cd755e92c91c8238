"""Similarity join of word n-gram sets by parity sketches.

1.  Every document gets its distinct shingles (hashed) and a digest of the set. Documents of one set are a
    class; the smallest id stands for it.
2.  *Parity sketch*: each shingle flips one bit. The sketches of two sets differ in no more bits than the
    sets have shingles that are not in both, as common shingles flip the same bits.
3.  *Size bands*: sets of sizes that can be near enough lie in one band, or the larger one just
    above it; it is posted in both. In a band two near sets differ in at most D shingles.
4.  *Pigeonhole*: a band's sketch is cut into more blocks than D, so near sets agree in all blocks but D. A
    block's key is the XOR of the whole hashes of its shingles: equal if they are, and, but for a chance of
    2^-64, not otherwise. Keys that one class alone has can agree with nothing; a class with too few others
    left is dropped; and of the rest only the rarest are posted, as many as near sets cannot all differ in.
5.  Posting lists are worked off in rounds through centres (``pairs``); pairs are screened by
    the Hamming distance of their sketches, which loses none, and verified on the full shingle sets.

Words are runs of bytes other than the six ASCII blanks, with A-Z in lower case. Sets are held as
64-bit hashes: two different shingles of one text pair collide with a chance of about 1e-11 at 20,000
words; two different sets pass for one class with a chance below 1e-20 a pair.

Defined results: null and empty texts, and texts of blanks, have no shingles and are linked
with nothing; repeated rows are copies of each other; rows that share an id and differ in text are judged
each by its own text; a row without an id takes no part and has no component; an empty table gives an
empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.ids import sized
from rollcall.llm.pairs import Sets, confirmer, far_bits, grouped, may_differ, sides, sizes_fit
from rollcall.llm.registry import query, table
from rollcall.llm.shingles import chunks, mix, shingles
from rollcall.operators.joins import join_small
from rollcall.session import once

WORDS = 4
#: Least similarity, in hundredths, so that it is compared in whole numbers.
SIMILARITY = 85
#: Largest size of a band over its smallest.
WIDTH = 1.5
#: Blocks beyond those that near sets may differ in, as a part of these.
SPARE = 0.25
#: Bits of the short sketch that goes along where posting lists are joined.
SHORT = 1024


class Bands:
    """Sizes of sets, cut into bands, and what near sets of a band may differ in."""

    def __init__(self, percent: int = SIMILARITY, largest: int = 1 << 40):
        self.percent = percent
        self.begins = [1]
        while self.begins[-1] < largest:
            self.begins.append(int(self.begins[-1] * WIDTH) + 1)

    def differ(self, n: int, band: int | None = None) -> int:
        """Most shingles that are not in both of two near sets, one of ``n`` and one that is larger, or in a ``band`` below."""
        other = 100 * n // self.percent
        if band is not None and n >= self.begins[band + 1]:
            other = self.begins[band + 1] - 1
        return (100 - self.percent) * (n + other) // (100 + self.percent)

    def of(self, n: int) -> int:
        return bisect_right(self.begins, n) - 1

    def both(self, n: int) -> list[int]:
        """Bands in which a set of ``n`` is posted: its own, and the one below if a partner can be there."""
        band = self.of(n)
        least = -(-self.percent * n // 100)
        return [band] + [band - 1] * (band > 0 and least < self.begins[band])

    def blocks(self, band: int) -> int:
        most = self.differ(self.begins[band + 1] - 1)
        return most + 1 + int(most * SPARE)


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, run in chunks(column.to_pylist()):
        hashes, n = shingles(run, words)
        for part in np.split(hashes, np.cumsum(n)[:-1]):
            yield np.unique(part)


def _digests(words: int):
    """(id, h, text) to (id, h, n_shingles, d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two = [], [], []
            for own in _sets(batch.column(2), words):
                sizes.append(len(own))
                one.append(np.add.reduce(own) if len(own) else np.uint64(0))
                two.append(np.bitwise_xor.reduce((own >> np.uint64(7)) * own) if len(own) else np.uint64(0))
            digest = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *digest]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n_shingles", "d1", "d2"])

    return run


def block_keys(own: np.ndarray, band: int, blocks: int) -> np.ndarray:
    """A key for each block of the sketch: the XOR of its shingles' hashes, mixed with band and place."""
    place = (own >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    keys = np.zeros(blocks, dtype=np.uint64)
    held, starts = np.unique(place[order], return_index=True)
    keys[held.astype(np.int64)] = np.bitwise_xor.reduceat(mix(own[order]), starts)
    return mix(keys + mix(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)))


def sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch, ``bits`` long (a power of two, 64 at least), as 64-bit numbers."""
    place = (mix(own) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches of one length differ."""
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def fold(whole: np.ndarray, longs: int) -> np.ndarray:
    """The sketch of the same set, but only so long."""
    return np.bitwise_xor.reduce(whole.reshape(-1, longs), axis=0)


#: Postings of one output batch.
BATCH_POSTINGS = 1 << 18


def _postings(words: int, percent: int):
    """(node, text) to (node, n, need, tok): all block keys of each band, and how many must be shared."""
    bands = Bands(percent)

    def listed(rows: list[tuple[int, int, int]], toks: list[np.ndarray]) -> pa.RecordBatch:
        each = np.repeat(np.array(rows, dtype=np.int64), [len(t) for t in toks], axis=0)
        columns = [*each.T, np.concatenate(toks).view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "n", "need", "tok"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toks, size = [], [], 0
        for batch in batches:
            for node, own in zip(batch.column(0).to_pylist(), _sets(batch.column(1), words), strict=True):
                if not bands.differ(len(own)):  # only equal sets are near, and those are one class
                    continue
                for band in bands.both(len(own)):
                    blocks = bands.blocks(band)
                    rows.append((node, len(own), blocks - bands.differ(len(own), band)))
                    toks.append(block_keys(own, band, blocks))
                    size += blocks
                    if size >= BATCH_POSTINGS:
                        yield listed(rows, toks)
                        rows, toks, size = [], [], 0
        if rows:
            yield listed(rows, toks)

    return run


def _sketches(words: int):
    """(node, text) to (node, bits, whole): the sketch folded to ``SHORT`` bits, and after the size of the set, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, whole = [], []
            for own in _sets(batch.column(1), words):
                bits = sketch(own, max(SHORT, 1 << len(own).bit_length()))
                short.append(fold(bits, SHORT // 64).tolist())
                whole.append([len(own), *bits.tolist()])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, kind), pa.array(whole, kind)], names=["node", "bits", "whole"])

    return run


def _screen(percent: int):
    """(a, b, whole_a, whole_b) to (a, b) of pairs whose sketches differ in no more bits than near sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (v.values.to_numpy() for v in (one, two))
                most = (100 - percent) * int(x[0] + y[0]) // (100 + percent)
                longs = min(len(x), len(y)) - 1
                keep.append(distance(fold(x[1:], longs), fold(y[1:], longs)) <= most)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


class Join:
    """The distinct sets of a table, who has them, and where they are posted."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, percent: int):
        self.words, self.percent = words, percent
        rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
        rows = rows.select("id", F.xxhash64("text").alias("h"), "text")
        documents = once(rows.mapInArrow(_digests(words), "id bigint, h bigint, n_shingles bigint, d1 bigint, d2 bigint"))
        self.sets = Sets(documents)
        texts = self.sets.firsts(rows).select("node", "text")
        self.posted = once(self._prefixes(texts))
        nodes = sized(self.posted.select("node").distinct())
        self.texts = once(texts.join(nodes, "node", "left_semi"))
        self.sketches = once(self.texts.mapInArrow(_sketches(words), "node bigint, bits array<bigint>, whole array<bigint>"))

    def _prefixes(self, texts: DataFrame) -> DataFrame:
        """(tok, node, n, weight): the rarest block keys, of which a class must share one with what is near."""
        keys = once(texts.mapInArrow(_postings(self.words, self.percent), "node bigint, n bigint, need bigint, tok bigint"))
        shared = once(keys.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))
        own = (
            join_small(keys, shared, ["tok"])
            .groupBy("node", "n", "need")
            .agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"), F.sum("df").alias("weight"))  # a text's at most
            .where(F.size("toks") >= F.col("need"))
        )
        prefix = F.slice("toks", F.lit(1), (F.size("toks") - F.col("need") + 1).cast("int"))
        return own.select(F.explode(F.transform(prefix, lambda t: t["tok"])).alias("tok"), "node", "n", "weight")

    def check(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are near enough: by their sketches, then on their full sets."""
        screened = sides(pairs, self.sketches, "whole").mapInArrow(_screen(self.percent), "a bigint, b bigint")
        return sides(screened, self.texts, "text").mapInArrow(confirmer(self.words, self.percent), "a bigint, b bigint")

    def components(self) -> DataFrame:
        """(node, component)."""
        return grouped(self.posted, self.percent, self.check, lambda nodes: self.sketches.join(sized(nodes), "node", "left_semi").select("node", "bits"), far_bits(SHORT // 64) <= may_differ(self.percent))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for each row of ``docs``."""
    join = Join(docs, key, text, words, percent)
    return join.sets.component_ids(join.components()).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as (a, b), and (doc_id, node) of the rows that have each set.

    There are as many links as there are; where only their groups matter, ``ngram_components`` forms far fewer pairs.
    """
    join = Join(docs, key, text, words, percent)
    here = join.posted.select("tok", "node", "n").join(join.sketches.select("node", "bits"), "node")
    there = here.select("tok", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "bits")])
    met = there.join(here, "tok").where((F.col("node_a") < F.col("node")) & sizes_fit(F.col("n_a"), F.col("n"), percent) & (far_bits(SHORT // 64) <= may_differ(percent)))
    members = join_small(join.sets.documents, join.sets.sets.select("n_shingles", "d1", "d2", "node"), ["n_shingles", "d1", "d2"])
    links = join.check(met.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct())
    return links, members.where("id IS NOT NULL").select(F.col("id").alias("doc_id"), "node")


_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Links by counting common shingles, and the smallest id that they reach.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_PLAIN} AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.doc_id WHERE r.c < l.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.c), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""


@query("op12_ngram_jaccard_join", SQL)
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 85 hundredths of their word 4-grams."""
    return ngram_components(table(spark, sf_dir, "documents"))
