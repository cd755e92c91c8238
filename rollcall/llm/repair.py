"""Repair of conversation structure: the cheapest edits that make the turns alternate.

A sound conversation is empty, or an optional system turn and then pairs of a user and an
assistant turn, told by the first letters of the roles: ``(s?(ua)+)?``. Blank and
repeated turns must go; other turns may be kept (0), given the role user or assistant (3) or
deleted (4); an empty user or assistant turn may be put in anywhere (3); a turn that
breaks off and stays costs 3 more. Of the cheapest edits the ones whose initials (D, I, K, R) are
least in ASCII order are taken.

1.  Turns are range-partitioned and sorted by conversation and turn, and stored with a number that
    grows along this order. ``PIECE`` successive numbers make a piece, whoever they belong to, so a
    conversation of any length is many pieces and no task holds more than one at a time.
2.  Repeated turns are those beyond the least number of their (conversation, role, text), which is
    aggregated map-side, stored, and joined by its measured size.
3.  *Square-root checkpointed DP* over one letter a turn: a vector holds the cost of the rest from each of
    the four states (nothing yet, after system, after user, after assistant). Going backward, only every
    square root of a piece's turns is its vector stored; walking forward, each block's vectors
    are worked out again from the checkpoint at its end, and the least tight edit is emitted.
4.  The ends of pieces inside one conversation are checkpoints too: each piece is a min-plus matrix,
    their suffix products give the vectors at all piece ends, and the state in which a piece begins
    follows from where the walk leaves the piece before it from each state.

Defined results: a null role or text is one space; turns go by number (null first), then by a hash of
role and text, so ties and repeated rows have one order; a role that begins with none of s, u, a
(an empty one too) can be changed or deleted but not kept; rows without a conversation id are one
conversation with a null id; of a turn with several faults the first counts (blank, duplicate,
truncated); an empty table has no conversations; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table
from rollcall.operators.joins import join_small
from rollcall.session import once

#: Turns of a piece, as a power of two.
PIECE_BITS = 12

DELETE, INSERT, RETYPE, BROKEN = 4, 3, 3, 3
#: States: nothing emitted, after system, after user, after assistant; and the states that may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The role that must come next in each state, and where it leads.
NEXT_ROLE = "uuau"
NEXT_STATE = (USER, USER, ASSISTANT, USER)
FAR = 1 << 40

Vector = tuple[int, int, int, int]


def _insertions(v: list[int]) -> Vector:
    """Costs where empty turns may be put in first; two reach every state worth reaching."""
    for _ in range(2):
        v = [min(own, INSERT + v[NEXT_STATE[q]]) for q, own in enumerate(v)]
    return tuple(min(x, FAR) for x in v)


#: Costs after the last turn.
END = _insertions([0, FAR, FAR, 0])


def _edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, its cost, next state) of a turn. ``code``: x must go, else the role's first letter (o for any
    other), in upper case if the turn breaks off."""
    out = [("D", DELETE, state)]
    if code != "x":
        cost, kind = BROKEN * code.isupper(), code.lower()
        if kind == NEXT_ROLE[state]:
            out.append(("K", cost, NEXT_STATE[state]))
        if kind == "s" and state == EMPTY:
            out.append(("K", cost, SYSTEM))
        out.append(("R", RETYPE + cost, NEXT_STATE[state]))
    return out


class Costs:
    """Backward costs and forward edits, remembered by (turn, costs behind it less their least)."""

    def __init__(self) -> None:
        self._back: dict[tuple[str, Vector], tuple[int, Vector]] = {}
        self._walk: dict[tuple[str, Vector, int], tuple[str, str, int]] = {}

    def back(self, code: str, behind: Vector) -> tuple[int, Vector]:
        """Costs from this turn on, given those behind it: their least, and each less the least."""
        known = self._back.get((code, behind))
        if known is None:
            v = self._full(code, behind)
            low = min(v)
            known = self._back[code, behind] = low, tuple(min(x - low, FAR) for x in v)
        return known

    @staticmethod
    def _full(code: str, behind: Vector) -> Vector:
        return _insertions([min(c + behind[to] for _, c, to in _edits(code, q)) for q in range(4)])

    def walk(self, code: str, behind: Vector, state: int) -> tuple[str, str, int]:
        """The edits at this turn, the roles they give (``-`` for none), and the state behind it."""
        known = self._walk.get((code, behind, state))
        if known is None:
            costs, edits, roles, q = self._full(code, behind), "", "", state
            while True:
                tight = [(e, to) for e, c, to in _edits(code, q) if c + behind[to] == costs[q]]
                if INSERT + costs[NEXT_STATE[q]] == costs[q]:
                    tight.append(("I", NEXT_STATE[q]))
                edit, to = min(tight)
                edits, roles = edits + edit, roles + (NEXT_ROLE[q] if edit in "IR" else "-")
                q = to
                if edit != "I":
                    break
            known = self._walk[code, behind, state] = edits, roles, q
        return known

    def backward(self, codes: str, behind: Vector, keep: int = 0) -> tuple[int, Vector, dict[int, Vector]]:
        """Costs before ``codes`` (least, rest), and those at every ``keep``-th place."""
        least, v, kept = 0, behind, {len(codes): behind}
        for i in range(len(codes) - 1, -1, -1):
            low, v = self.back(codes[i], v)
            least += low
            if keep and i % keep == 0:
                kept[i] = v
        return least, v, kept

    def forward(self, codes: str, state: int, behind: Vector) -> tuple[int, list[str], list[str], int]:
        """Cost, edits and roles turn by turn, and the state at the end."""
        step = isqrt(len(codes)) + 1
        least, first, kept = self.backward(codes, behind, step)
        edits, roles, q = [], [], state
        for begin in range(0, len(codes), step):
            end = min(begin + step, len(codes))
            block = [kept[end]]
            for i in range(end - 1, begin, -1):
                block.append(self.back(codes[i], block[-1])[1])
            for i in range(begin, end):
                e, r, q = self.walk(codes[i], block.pop(), q)
                edits.append(e)
                roles.append(r)
        return least + first[state], edits, roles, q


def _normal(v: list[int]) -> tuple[int, Vector]:
    low = min(v)
    return low, tuple(min(x - low, FAR) for x in v)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, start, codes) to (group, start, costs from each state to each)."""
    costs = Costs()
    for batch in batches:
        out = []
        for codes in batch.column(2).to_pylist():
            columns = []
            for to in range(4):
                least, v, _ = costs.backward(codes, tuple(0 if q == to else FAR for q in range(4)))
                columns.append([min(least + x, FAR) for x in v])
            out.append([columns[to][q] for q in range(4) for to in range(4)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["group", "start", "costs"]
        )


def _tails(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each piece of one conversation: suffix products of the matrices."""
    pieces = pieces.sort_values("start", ascending=False)
    v, base, tails, bases = END, 0, [], []
    for m in pieces["costs"]:
        tails.append(list(v))
        bases.append(base)
        low, v = _normal([min(m[4 * q + to] + v[to] for to in range(4)) for q in range(4)])
        base += low
    return pieces[["group", "start"]].assign(tail=tails, base=bases, last=[True] + [False] * (len(tails) - 1))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, start, codes, tail) to (group, start, state behind the piece from each state)."""
    costs = Costs()
    for batch in batches:
        out = [
            [costs.forward(codes, q, tuple(tail))[3] for q in range(4)]
            for codes, tail in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["group", "start", "exits"]
        )


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of one conversation begins."""
    pieces = pieces.sort_values("start")
    state, entries = EMPTY, []
    for exits in pieces["exits"]:
        entries.append(state)
        state = int(exits[state])
    return pieces[["start"]].assign(entry=entries)


#: Edits of one output batch; a few pieces of long conversations fill it.
BATCH_EDITS = 1 << 16
ROLES = {"u": "user", "a": "assistant", "-": None}


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, start, codes, entry, tail, base, last) to (conv, start, cost, edits of each place)."""
    costs = Costs()
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(1, 7)]
        begin, cost, sizes, flat = 0, [], [], ([], [], [])
        for row, (start, codes, entry, tail, base, last) in enumerate(zip(*columns, strict=True)):
            total, edits, roles, q = costs.forward(codes, entry or EMPTY, END if tail is None else tuple(tail))
            before = len(flat[0])
            for i, (es, rs) in enumerate(zip(edits, roles, strict=True)):
                flat[0].extend(es)
                flat[1].extend(ROLES[r] for r in rs)
                flat[2].extend(None if e == "I" else start + i for e in es)
            if last is not False:  # turns put in behind the last one
                while q not in (EMPTY, ASSISTANT):
                    for column, value in zip(flat, ("I", ROLES[NEXT_ROLE[q]], None), strict=True):
                        column.append(value)
                    q = NEXT_STATE[q]
            cost.append(total + (base or 0))
            sizes.append(len(flat[0]) - before)
            if len(flat[0]) >= BATCH_EDITS:
                yield _repaired(batch.slice(begin, row + 1 - begin), cost, sizes, flat)
                begin, cost, sizes, flat = row + 1, [], [], ([], [], [])
        yield _repaired(batch.slice(begin), cost, sizes, flat)


def _repaired(rows: pa.RecordBatch, cost: list[int], sizes: list[int], flat: tuple[list, list, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64())
    edits = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names=["edit", "role", "at"])
    offsets = pa.array([0, *accumulate(sizes)], pa.int32())
    columns = [rows.column(0), rows.column(1), pa.array(cost, pa.int64()), pa.ListArray.from_arrays(offsets, edits)]
    return pa.RecordBatch.from_arrays(columns, names=["conv", "start", "cost", "edits"])


BLANKS = r"\x20\x09-\x0D"


def _letters(fault: Column) -> tuple[Column, Column]:
    """A turn's letter for the DP, and its role's first letter or ``o``."""
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    must_go = fault.isin("blank", "duplicate")
    return F.when(must_go, "x").when(fault == "truncated", F.upper(initial)).otherwise(initial), initial


@dataclass(frozen=True)
class Repair:
    """``edits``: a row per edit (conv, start, seq, edit, role, text, at), in the order (start, seq) within a
    conversation; ``role`` and ``text`` are those of the repaired turn, also of one that goes.
    ``turns``: the turns as they came, numbered, with ``fault``. ``conversations``: cost and faults."""

    edits: DataFrame
    turns: DataFrame
    conversations: DataFrame


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_bits: int = PIECE_BITS) -> Repair:
    """The cheapest repair of every conversation."""
    blank = F.lit(" ")
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    ).withColumn("tie", F.xxhash64("role", "text"))
    # rows that are equal in all of this may be dealt apart, as their order does not matter
    order = ["conv", "turn", "tie", "salt"]
    sorted_rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    id_text = F.coalesce(F.concat(F.lit("+"), F.col("conv").cast("string")), F.lit("-"))
    same = F.concat_ws(":", id_text, F.length("role").cast("string"), "role", "text")
    ends = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    stored = once(
        sorted_rows.select("conv", "turn", "role", "text", F.unhex(F.sha2(same, 256)).alias("same"), ends.alias("ending"), F.monotonically_increasing_id().alias("at"))
    )
    narrow = stored.select("conv", "turn", "role", "same", "ending", "at")
    repeated = once(narrow.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    fault = (
        F.when(F.col("ending") == "", "blank")
        .when(F.col("at") > F.col("first"), "duplicate")
        .when(~F.col("ending").isin(".", "!", "?"), "truncated")
    )
    turns = join_small(narrow, repeated, ["same"], "left").withColumn("fault", fault)
    code, initial = _letters(F.col("fault"))
    turns = once(turns.select("conv", "turn", "at", "fault", code.alias("code"), initial.alias("initial")))

    piece = F.shiftright("at", piece_bits)
    listed = F.sort_array(F.collect_list(F.struct("at", "code", "initial")))  # a piece's turns at most
    pieces = turns.groupBy("conv", piece.alias("piece")).agg(listed.alias("l")).select(
        "conv",
        F.col("l")[0]["at"].alias("start"),
        F.array_join("l.code", "").alias("codes"),
        F.array_join("l.initial", "").alias("initials"),
    )
    pieces = once(pieces)
    # conversations of several pieces: a name for each, as ids may be null
    cut = pieces.groupBy("conv").agg(F.min("start").alias("group"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = once(pieces.select(F.struct("conv").alias("c"), "start", "codes").join(cut.select(F.struct("conv").alias("c"), "group"), "c").drop("c"))
    matrices = several.select("group", "start", "codes").mapInArrow(_matrices, "group bigint, start bigint, costs array<bigint>")
    tails = once(matrices.groupBy("group").applyInPandas(_tails, "group bigint, start bigint, tail array<bigint>, base bigint, last boolean"))
    exits = several.join(tails, ["group", "start"]).select("group", "start", "codes", "tail").mapInArrow(
        _exits, "group bigint, start bigint, exits array<int>"
    )
    entries = exits.groupBy("group").applyInPandas(_entries, "start bigint, entry int")
    inner = once(tails.join(entries, "start").select("start", "entry", "tail", "base", "last"))
    planned = join_small(pieces, inner, ["start"], "left").select("conv", "start", "codes", "entry", "tail", "base", "last")
    schema = planned.select("conv").schema.simpleString()[len("struct<conv:") : -1]
    repaired = once(
        planned.mapInArrow(_repairs, f"conv {schema}, start bigint, cost bigint, edits array<struct<edit:string,role:string,at:bigint>>")
    )
    edits = repaired.select("conv", "start", F.posexplode("edits").alias("seq", "e")).select("conv", "start", "seq", "e.edit", F.col("e.role").alias("new"), "e.at")
    said = stored.select("at", F.col("role").alias("old"), "text")
    met = edits.where("at IS NOT NULL").join(said, "at").select("conv", "start", "seq", "edit", F.coalesce("new", "old").alias("role"), "text", "at")
    put_in = edits.where("at IS NULL").select("conv", "start", "seq", "edit", F.col("new").alias("role"), F.lit("").alias("text"), "at")
    return Repair(met.unionByName(put_in), turns, _conversations(turns, pieces, repaired))


def _conversations(turns: DataFrame, pieces: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    kinds = ("blank", "duplicate", "truncated")
    by_turn = turns.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    faults = by_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    # adjacent letters inside a piece, and across the ends of two pieces of one conversation
    sound = F.lit(r"(?=su|ua|au)")
    inner = F.length("initials") - 1 - F.regexp_count("initials", sound)
    ends = pieces.groupBy("conv").agg(
        F.sum(inner).alias("inner"),
        F.sort_array(F.collect_list(F.struct("start", F.left("initials", F.lit(1)).alias("a"), F.right("initials", F.lit(1)).alias("z")))).alias("e"),
    )
    pairs = F.transform(F.slice("e", F.lit(2), F.size("e")), lambda x, i: F.concat(F.get("e", i)["z"], x["a"]))
    illegal = F.col("inner") + F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    plan = repaired.groupBy("conv").agg(
        F.max("cost").alias("cost"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("start", F.array_join("edits.edit", "").alias("a")))), lambda x: x["a"]), ""
        ).alias("audit"),
    )
    parts = [faults, ends.select("conv", illegal.cast("bigint").alias("illegal")), plan]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy("conv").agg(*[F.max(c).alias(c) for c in whole.columns if c != "conv"])


def damage(df: DataFrame) -> DataFrame:
    """``conversations`` with every twentieth kind of turn harmed, as the query's contract lays down."""
    rows = df.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return (
        rows.withColumn("kind", kind)
        .where("kind <> 0")
        .withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    )


def digests(source: DataFrame, done: Repair) -> DataFrame:
    """One row per conversation of ``source``: faults, cost, audit, and the digest of the repaired turns."""
    line = F.concat("role", F.lit(":"), "text")
    spoken = done.edits.where("edit <> 'D'").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("start", "seq", line.alias("line")))).alias("l"))
    spoken = spoken.select("conv", F.sha2(F.encode(F.array_join("l.line", "\n"), "utf-8"), 256).alias("repaired_sha256"))
    facts = source.select(F.col("conv_id").alias("conv")).distinct()
    for part in (done.conversations, spoken):
        facts = facts.unionByName(part, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return facts.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
  lambda c: list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)"""

SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations
), harmed AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, LATERAL (SELECT unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again) WHERE f <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed
), told AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), rows AS (
  SELECT conv_id, i, r, role, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM told
), back AS (
  SELECT conv_id, max(i) + 1 AS i, 0 AS c0, 6 AS cs, 3 AS cu, 0 AS ca FROM rows GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(r0, 3 + ru, 6 + ra), least(rs, 3 + ru, 6 + ra), least(ru, 3 + ra), least(ra, 3 + ru) FROM (
    SELECT b.conv_id, r.i,
      least(4 + c0, CASE WHEN gone THEN 9999999 ELSE t + least(3 + cu, CASE r WHEN 's' THEN cs WHEN 'u' THEN cu ELSE 9999999 END) END) AS r0,
      least(4 + cs, CASE WHEN gone THEN 9999999 ELSE t + cu + CASE r WHEN 'u' THEN 0 ELSE 3 END END) AS rs,
      least(4 + cu, CASE WHEN gone THEN 9999999 ELSE t + ca + CASE r WHEN 'a' THEN 0 ELSE 3 END END) AS ru,
      least(4 + ca, CASE WHEN gone THEN 9999999 ELSE t + cu + CASE r WHEN 'u' THEN 0 ELSE 3 END END) AS ra
    FROM back b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)
), costs AS (
  SELECT conv_id, i, [c0, cs, cu, ca] AS c FROM back
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS said, false AS done FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
    CASE e WHEN 'D' THEN q WHEN 'E' THEN q WHEN 'K' THEN CASE WHEN r = 's' THEN 2 ELSE nxt END ELSE nxt END,
    CASE WHEN e = 'E' THEN audit ELSE audit || e END,
    CASE e WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, nr || ':' || text)
      WHEN 'I' THEN list_append(said, nr || ':') ELSE said END, e = 'E'
  FROM (
    SELECT w.*, r.r, r.role, r.text, [3, 3, 4, 3][q] AS nxt, ['user', 'user', 'assistant', 'user'][q] AS nr,
      CASE WHEN r.i IS NULL THEN CASE WHEN q IN (1, 4) THEN 'E' ELSE 'I' END
        WHEN 4 + n.c[q] = o.c[q] THEN 'D'
        WHEN 3 + o.c[[3, 3, 4, 3][q]] = o.c[q] THEN 'I'
        WHEN (r.r = 's' AND q = 1 AND t + n.c[2] = o.c[q]) OR (r.r = ['u', 'u', 'a', 'u'][q] AND t + n.c[[3, 3, 4, 3][q]] = o.c[q]) THEN 'K'
        ELSE 'R' END AS e
    FROM walk w JOIN costs o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i
    LEFT JOIN costs n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i + 1
    LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
    WHERE NOT w.done)
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id
)
SELECT s.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
  coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(c.c[1], 0)::BIGINT AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.i = 1
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.done
"""


@query("op13_structure_repair", SQL)
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired."""
    source = table(spark, sf_dir, "conversations")
    return digests(source, repair(damage(source)))
