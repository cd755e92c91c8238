"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

A window is as many successive words of a document as a benchmark item has. Its features are
its five-word shingles, weighted by how often they occur in it; two windows are alike if
the sum of the lesser weights is at least ``SIMILARITY`` hundredths of the sum of the greater
ones.

1.  *Windows.* Of a window that is like an item, 6 of 7 shingles at least are the item's. So the places where a document
    holds shingles of an item are listed, and every window of the item's size that takes in that
    many of them is formed, and no other; none that can be like the item is left out.
2.  *Fingerprints.* A window's 64 bits are the signs of its summed shingle bits; running
    sums over a document give all its windows' bits at once.
3.  *Multi-index.* The 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints that differ in at
    most ``RADIUS`` bits differ in at most one bit in some block, so each item is stored under
    every block value within one bit of its own, and an equality join on (size, block,
    value) finds all items within the radius.
4.  *Verify.* Candidates are compared on their weighted shingles, exactly.

A like window of an item differs in about 11 of 64 bits at the least similarity;
``RADIUS`` is four to five standard deviations above that.

Words are runs of anything but the six ASCII blanks, in lower case. Defined results: null and
empty texts and items match nothing; an item of fewer words than a shingle is one shingle
as a whole, and so are its windows; items with equal texts all match; repeated rows
match each for itself but are reported once per id; rows without an id are reported under
a null id; either table may be empty; columns with other names are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.ids import without
from rollcall.llm.registry import query, table
from rollcall.session import once

WORDS = 5
SIMILARITY = 75
BITS = 64
BLOCKS = 13
#: One bit per block may differ, and one more in all but one of them.
RADIUS = 2 * BLOCKS - 1
#: Distinct item shingles (8 bytes each) that may be sent to all executors.
BROADCAST_SHINGLES = 2_000_000

_LANES = (1 << 32) | 1


def _words(text: Column) -> Column:
    """Words in lower case; none for null."""
    blanks = " \t\n\x0b\x0c\r"
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(blanks))
    return F.when(plain == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(plain, "[ \t\n\x0b\x0c\r]+"))


def _shingles(words: str, width: int) -> Column:
    """Hashes of all runs of ``width`` words."""
    return F.when(
        F.size(words) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
        ),
    )


def _hashed(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(k, h, sh): id, hash of the text, shingle hashes in order; null if there are none.

    No filter on ``sh`` may follow, explode()'s own included: Spark would move it below and hash
    all shingles again for it."""
    return (
        df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
        .select("k", F.xxhash64("t").alias("h"), _words(F.col("t")).alias("words"))
        .select("k", "h", _shingles("words", width).alias("sh"))
    )


def _fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp``: the 64 signs of the summed shingle bits of ``ws``."""
    bits = windows.select(*keys, F.explode("ws").alias("s"))
    # two counts to a sum: bit b in the low half, bit b + 32 in the high half
    sums = [F.sum(F.shiftright("s", b).bitwiseAND(F.lit(_LANES))).alias(f"c{b}") for b in range(32)]
    counted = bits.groupBy(*keys).agg(F.count("*").alias("n"), *sums)

    def sign(b: int) -> Column:
        pair = F.col(f"c{b % 32}")
        ones = pair.bitwiseAND(F.lit((1 << 32) - 1)) if b < 32 else F.shiftright(pair, 32)
        return F.when(ones * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))

    # stored, as the index below names the fingerprint many times
    return once(counted.select(*keys, reduce(Column.bitwiseOR, [sign(b) for b in range(BITS)]).alias("fp")))


def _blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)]


def _index(df: DataFrame, near: bool) -> DataFrame:
    """A row for each block of ``fp``, and, if ``near``, for each value one bit away."""
    entries = []
    for b, (first, size) in enumerate(_blocks()):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
        for flip in [0, *[1 << i for i in range(size)]] if near else [0]:
            entries.append(F.struct(F.lit(b).alias("block"), value.bitwiseXOR(F.lit(flip)).alias("value")))
    return df.select("*", F.explode(F.array(*entries)).alias("e")).select("*", "e.block", "e.value").drop("e")


def _of_width(docs: DataFrame, items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Matches of items whose shingles have ``width`` words."""
    grams = items.select("item", "size", F.size("ws").alias("m"), F.explode("ws").alias("s")).distinct()
    few = grams.count() <= BROADCAST_SHINGLES
    hashed = _hashed(docs, key, text, width)
    places = (
        hashed.select("k", "h", F.size("sh").alias("len"), F.posexplode_outer("sh").alias("pos", "s"))
        .join(F.broadcast(grams) if few else grams, "s")
        .groupBy("k", "h", "len", "item", "size", "m")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))  # of one document
    )
    # like: common / (own + item's - common) >= SIMILARITY hundredths
    own = F.least("m", "len")
    need = F.ceil((own + F.col("m")) * SIMILARITY / (100 + SIMILARITY)).cast("int")
    places = places.select("k", "h", "len", "size", "at", own.alias("own"), need.alias("need")).where(F.size("at") >= F.col("need"))
    # windows that take in ``need`` places from the i-th on begin from ``low`` to ``high``
    low = F.greatest(F.lit(0), F.get("at", F.col("i") + F.col("need") - 1) - F.col("own") + 1)
    high = F.least(F.get("at", F.col("i")), F.col("len") - F.col("own"))
    windows = (
        places.select("*", F.explode(F.sequence(F.lit(0), F.size("at") - F.col("need"))).alias("i"))
        .select("k", "h", "size", low.alias("low"), high.alias("high"))
        .where("low <= high")
        .select("k", "h", "size", F.explode(F.sequence("low", "high")).alias("begin"))
        .distinct()
    )
    per_doc = once(windows.groupBy("k", "h").agg(F.collect_list(F.struct("begin", "size")).alias("wins")))
    small = per_doc.count() <= BROADCAST_SHINGLES
    chosen = per_doc.select(F.col("k").alias("k2"), F.col("h").alias("h2"))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))
    source = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    held = source.join(F.broadcast(chosen) if small else chosen, same, "left_semi").distinct()
    cut = F.least(F.col("w.size") - width + 1, F.size("sh"))
    cuts = (
        _hashed(held, "k", "t", width)
        .join(per_doc.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "wins"), same)
        .select("k", "h", "sh", F.explode("wins").alias("w"))
        .select("k", "h", "sh", F.col("w.size").alias("size"), cut.alias("n"), F.least(F.col("w.begin"), F.size("sh") - cut).alias("begin"))
        .select("k", "h", "size", "begin", F.slice("sh", F.col("begin") + 1, F.col("n")).alias("ws"))
        .distinct()
    )
    cuts = once(cuts)
    window = ["k", "h", "size", "begin"]
    left = _index(_fingerprints(cuts, window), near=False)
    right = _index(_fingerprints(items, ["item", "size"]), near=True).withColumnRenamed("fp", "item_fp")
    candidates = (
        left.join(right, ["size", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select(*window, "item")
        .distinct()
    )
    weights = items.select("item", F.size("ws").alias("item_n"), F.explode("ws").alias("s")).groupBy("item", "item_n", "s").agg(
        F.count("*").alias("item_c")
    )
    match = [F.col(f"c.{x}").eqNullSafe(F.col(f"x.{x}")) for x in window]
    shared = (
        candidates.alias("c")
        .join(cuts.alias("x"), reduce(Column.__and__, match))
        .select(*[f"c.{x}" for x in window], "c.item", F.size("x.ws").alias("n"), F.explode("x.ws").alias("s"))
        .groupBy(*window, "item", "n", "s")
        .agg(F.count("*").alias("c"))
        .join(weights, ["item", "s"])
        .groupBy(*window, "item", "n", "item_n")
        .agg(F.sum(F.least("c", "item_c")).alias("both"))
    )
    union = F.col("n") + F.col("item_n") - F.col("both")
    return shared.where(F.col("both") * 100 >= union * SIMILARITY).select(
        "k", "item", F.col("begin"), F.col("size"), (F.col("both") / union).alias("similarity")
    )


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``begin``, ``n_words``, ``similarity``): for each document and
    item that match, the most similar window (the first of equals) and its place in words."""
    texts = benchmark.select(F.col(item_key).alias("item"), _words(F.col(item_text).cast("string")).alias("words")).distinct()
    texts = once(texts.where(F.size("words") > 0).withColumn("size", F.size("words")))
    widths = [r[0] for r in texts.select(F.least("size", F.lit(WORDS))).distinct().collect()]  # 1 to WORDS
    found = None
    for width in sorted(widths) or [WORDS]:
        items = texts.where(F.least("size", F.lit(WORDS)) == width).select("item", "size", _shingles("words", width).alias("ws"))
        more = _of_width(docs, items, key, text, width)
        found = more if found is None else found.unionByName(more)
    best = F.max(F.struct("similarity", (-F.col("begin")).alias("b"), "size")).alias("m")
    return found.groupBy("k", "item").agg(best).select(
        F.col("k").alias("doc_id"),
        F.col("item").alias("item_id"),
        (-F.col("m.b")).alias("begin"),
        F.col("m.size").alias("n_words"),
        F.col("m.similarity").alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark passage; rows without an id stay."""
    return without(docs, contaminations(docs, benchmark, key, text).select(F.col("doc_id").alias("id")), key)


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in the documents."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
