"""Removal of repeated runs of lines, by winnowing and by stretches.

1.  Each document is cut into lines. A *gram* is the shortest stretch of whole lines from one
    line on that has ``GRAM_WORDS`` words or more; its hash is that of its lines.
2.  *Winnowing*: of the grams that begin within ``RUN_WORDS - GRAM_WORDS`` words of a line, the
    one with the least hash is selected. The choice depends on these lines alone, so two
    documents that share a run of ``RUN_WORDS`` words select the same gram in it.
3.  *Join*: every selected gram meets the first place, by document and line, at which it was
    selected.
4.  *Extend*: along such a meeting lines are compared both ways until they differ.
5.  *Stretches*: the shortest stretches of whole lines from each line on, and up to each line,
    that have ``RUN_WORDS`` words or more are grouped by their hash. All but the first place of each
    are repeats, whatever earlier document they stood in.
6.  *Delete*: the run goes from the later place; the first place stays.

Every line of a run of ``RUN_WORDS`` words lies in a stretch that begins at one of its lines or
ends at one and stays inside it. So such a run goes whole if it stood anywhere before, even where its
grams first stood in other documents; one shorter than ``GRAM_WORDS`` never goes, and those
between depend on the selection. A gram or stretch that a third of all documents hold meets one
first place, however often it occurs; nothing is paired within a list.

Defined results: a null text stays null, an empty one empty; a document all of whose lines
go keeps an empty text; lines are compared without blanks at their ends; blank lines have no
words and go with a run if they lie inside it; rows with the same id and text are one
document and come out alike; of rows with one id and different texts the order is that
of their text hash; rows without an id come first; tables may be empty; all other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table
from rollcall.operators.joins import join_aggregate
from rollcall.session import once

GRAM_WORDS = 25
RUN_WORDS = 50


def _line_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, lines): a document's id, the hash of its text, and its lines that have words,
    as an array of (pos, f, w): place among all lines, hash, number of words."""

    def line(x: Column, i: Column) -> Column:
        plain = F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))
        return F.struct(
            i.alias("pos"), F.xxhash64(plain).alias("f"), F.regexp_count(plain, F.lit("[^ ]+")).alias("w")
        )

    return (
        docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
        .where("t IS NOT NULL")
        .select(
            "k",
            F.xxhash64("t").alias("h"),
            F.filter(F.transform(F.split("t", "\n"), line), lambda x: x["w"] > 0).alias("lines"),
        )
    )


def _placed(hashed: DataFrame, gram_words: int, run_words: int) -> DataFrame:
    """A row for each line (k, h) that a stretch begins or ends at. ``best``: (g, i), the gram selected
    at it. ``onward`` and ``back``: (a, z, s), places of the first and last line, and hash, of the shortest
    stretch from it and up to it. Null where too few words follow or stand before, or where ``back`` is the
    ``onward`` of its first line."""
    document = Window.partitionBy("k", "h")
    rows = hashed.select("k", "h", F.posexplode("lines").alias("i", "line"))
    rows = rows.select("k", "h", "i", "line.pos", "line.f", "line.w")
    before = document.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("c", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("d", F.col("c") + F.col("w"))
    gram = document.orderBy("c").rangeBetween(0, gram_words - 1)
    window = document.orderBy("c").rangeBetween(0, run_words - gram_words - 1)
    onwards = document.orderBy("c").rangeBetween(0, run_words - 1)
    upto = document.orderBy("d").rangeBetween(1 - run_words, 0)

    def stretch(a: Column, z: Column, over: Window) -> Column:
        return F.struct(a.alias("a"), z.alias("z"), F.xxhash64(F.collect_list("f").over(over)).alias("s"))

    starts = F.sum("w").over(onwards) >= run_words
    ends = F.sum("w").over(upto) - F.col("w") >= run_words  # its first line's own stretch ends sooner
    return (
        rows.withColumn("g", F.xxhash64(F.collect_list("f").over(gram)))
        .select(
            "k",
            "h",
            F.when(starts, F.min(F.struct("g", "i")).over(window)).alias("best"),
            F.when(starts, stretch(F.col("pos"), F.max("pos").over(onwards), onwards)).alias("onward"),
            F.when(ends, stretch(F.min("pos").over(upto), F.col("pos"), upto)).alias("back"),
        )
        .where("onward IS NOT NULL OR back IS NOT NULL")
    )


def selected_grams(placed: DataFrame) -> DataFrame:
    """(k, h, i, g): the lines at which a selected gram begins, and its hash."""
    return placed.where("best IS NOT NULL").select("k", "h", "best.i", "best.g").distinct()


def repeated_stretches(placed: DataFrame) -> DataFrame:
    """(k, h, pos): places of the lines of all stretches that stood before."""
    stretches = placed.select("k", "h", F.explode(F.array_compact(F.array("onward", "back"))).alias("x")).select("k", "h", "x.*")
    first = stretches.groupBy("s").agg(F.min(F.struct("k", "h", "a")).alias("p"), F.count("*").alias("n"))
    later = join_aggregate(stretches, first.where("n > 1").drop("n"), ["s"]).where(~F.struct("k", "h", "a").eqNullSafe(F.col("p")))
    return later.select("k", "h", F.explode(F.sequence("a", "z")).alias("pos"))


def _same(a: str, b: str) -> Column:
    """Equal (id, text hash), null ids included."""
    return F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    gram_words: int = GRAM_WORDS,
    run_words: int = RUN_WORDS,
) -> DataFrame:
    """(k, h, gone): per document the places of the lines that repeat an earlier run, sorted."""
    # a filter on the lines ahead of this would be pushed down and hash them all twice
    hashed = once(_line_hashes(docs, key, text).distinct()).where(F.size("lines") > 0)
    placed = once(_placed(hashed, gram_words, run_words))
    picked = once(selected_grams(placed))
    first = picked.groupBy("g").agg(F.min(F.struct("k", "h", "i")).alias("p"), F.count("*").alias("n"))
    meetings = (
        join_aggregate(picked, first.where("n > 1").drop("n"), ["g"])
        .where(~F.struct("k", "h", "i").eqNullSafe(F.col("p")))
        .groupBy("k", "h", F.col("p.k").alias("k0"), F.col("p.h").alias("h0"), (F.col("i") - F.col("p.i")).alias("shift"))
        .agg(F.array_sort(F.collect_list("i")).alias("at"))
    )
    later, earlier = hashed.alias("l"), hashed.alias("e")
    pairs = meetings.select(
        F.struct("k", "h").alias("m"), F.struct(F.col("k0").alias("k"), F.col("h0").alias("h")).alias("o"), "shift", "at"
    )
    pairs = (
        pairs.join(later, F.col("m.k").eqNullSafe(F.col("l.k")) & (F.col("m.h") == F.col("l.h")))
        .select("m", "o", "shift", "at", F.col("l.lines").alias("own"))
        .join(earlier, F.col("o.k").eqNullSafe(F.col("e.k")) & (F.col("o.h") == F.col("e.h")))
        .select("m", "shift", "at", "own", F.col("e.lines").alias("other"))
    )
    low = F.greatest(F.lit(0), F.col("shift"))
    high = F.least(F.size("own"), F.size("other") + F.col("shift"))
    differ = F.filter(
        F.sequence(low, high - 1), lambda x: F.get("own", x)["f"] != F.get("other", x - F.col("shift"))["f"]
    )
    walls = F.concat(F.array(low - 1), differ, F.array(high))
    stretches = F.filter(
        F.transform(
            F.slice("walls", F.lit(1), F.size("walls") - 1),
            lambda b, j: F.struct((b + 1).alias("a"), (F.get("walls", j + 1) - 1).alias("z")),
        ),
        lambda s: (s["z"] >= s["a"]) & F.exists("at", lambda p: p.between(s["a"], s["z"])),
    )
    return (
        pairs.withColumn("walls", walls)
        .select("m", "own", F.explode(stretches).alias("s"))
        .select(
            "m.k",
            "m.h",
            F.explode(F.sequence(F.get("own", F.col("s.a"))["pos"], F.get("own", F.col("s.z"))["pos"])).alias("pos"),
        )
        .unionByName(repeated_stretches(placed))
        .groupBy("k", "h")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    gram_words: int = GRAM_WORDS,
    run_words: int = RUN_WORDS,
    count: str | None = None,
) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of ``text``; ``count`` names an extra
    column for the number of lines that went."""
    # stored, so that rows that share a key (those without id and text) can be split when they meet it; shuffled at every
    # size, as what goes grows with the documents
    gone = once(repeated_lines(docs, key, text, gram_words, run_words)).hint("merge").alias("g")
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("h")
    ).alias("d")
    lines = F.split(F.col("d.row")[text].cast("string"), "\n")
    walls = F.concat(F.array(F.lit(-1)), F.col("g.gone"), F.array(F.size(lines)))
    joined = rows.join(gone, _same("d", "g"), "left").select("row", "gone", lines.alias("lines"), walls.alias("walls"))
    kept = F.flatten(
        F.transform(
            F.slice("walls", F.lit(1), F.size("walls") - 1),
            lambda b, j: F.slice("lines", b + 2, F.get("walls", j + 1) - b - 1),
        )
    )
    new = F.when(F.col("gone").isNull(), F.col("row")[text].cast("string")).otherwise(F.array_join(kept, "\n"))
    columns = [(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(count))
    return joined.select(*columns)


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stood in an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count="lines_gone")
