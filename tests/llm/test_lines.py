from rollcall.llm.lines import dedup_lines
from tests.llm.conftest import prose


def run(df, **more):
    return {r.doc_id: r.text for r in dedup_lines(df, **more).collect()}


def test_later_runs_go_and_the_first_stays(docs):
    passage = "\n".join(prose(s, 20) for s in (1, 2, 3))  # 60 words in three lines
    long_line = prose(9, 60)
    rows = [
        (1, f"start\n{passage}\nend"),
        (2, f"other\n{passage}\nlast"),
        (3, f"{long_line}\nx\n{long_line}"),
        (4, f"y\n{long_line}  "),
        (5, passage),
        (6, prose(1, 20)),  # too short to be a run
    ]
    got = run(docs(rows))
    assert got[1] == rows[0][1]
    assert got[2] == "other\nlast"
    assert got[3] == f"{long_line}\nx"
    assert got[4] == "y"
    assert got[5] == ""
    assert got[6] == prose(1, 20)


def test_a_run_is_carried_on_both_ways(docs):
    tail = "\n".join(f"t{i}" for i in range(8))
    run_text = f"head\n{tail}\n\n{prose(4, 55)}\n{tail}"
    got = run(docs([(1, f"a\n{run_text}\nb"), (2, f"c\n{run_text}\nd")]))
    assert got[2] == "c\nd"


def test_windows_of_brute_force_all_go(docs):
    rows = []
    for i in range(30):
        parts = [prose(100 + (i * k) % 17, 12 + 5 * k) for k in range(1, 6)] + [prose(500 + i, 15)]
        rows.append((i, "\n".join(parts)))
    got, seen = run(docs(rows)), set()
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            n, b = 0, a
            while b < len(lines) and n < 50:
                n, b = n + len(lines[b].split()), b + 1
            if n >= 50:
                if tuple(lines[a:b]) in seen:
                    gone |= set(range(a, b))
                seen.add(tuple(lines[a:b]))
        left = got[i].split("\n") if got[i] else []
        assert not gone & {lines.index(x) for x in left}


def test_a_run_goes_whole_though_its_grams_stood_elsewhere(docs):
    rows, want = [], {}
    for n in range(0, 24, 3):
        p, q = prose(n + 1, 30), "\n".join(prose(1000 + 10 * n + j, 6) for j in range(5))
        u, v = ([prose(base + n + j, 40) for j in range(3)] for base in (2000, 3000))
        rows += [(n, f"{u[0]}\n{p}\n{v[0]}")] + [(n + j, f"{u[j]}\n{p}\n{q}\n{v[j]}") for j in (1, 2)]
        want[n + 2] = f"{u[2]}\n{v[2]}"
    got = run(docs(rows))
    assert {k: got[k] for k in want} == want


def test_the_end_of_a_run_goes_too(docs):
    p, q, tail = prose(1, 30), prose(2, 55), "t1 t2\nt3"
    rows = [(0, f"a\n{p}\nb"), (1, f"c\n{q}\nd"), (2, f"e\n{p}\n{q}\n{tail}\nf"), (3, f"g\n{p}\n{q}\n{tail}\nh")]
    assert run(docs(rows))[3] == "g\nh"


def test_nulls_copies_and_other_columns(docs):
    text = prose(3, 80)
    rows = [(1, None), (2, ""), (None, text), (None, text), (3, text), (3, text), (4, "\n\n"), (5, "x\n" * 3000)]
    df = docs(rows)
    out = dedup_lines(df, count="n_gone")
    assert out.columns == [*df.columns, "n_gone"]
    got = sorted(((r.doc_id, r.text, r.n_gone) for r in out.collect()), key=repr)
    want = [(1, None, 0), (2, "", 0), (None, text, 0), (None, text, 0), (3, "", 1), (3, "", 1), (4, "\n\n", 0), (5, "x\n", 2999)]
    assert got == sorted(want, key=repr)


def test_empty_table(docs):
    assert dedup_lines(docs([])).count() == 0


def test_hot_rows_are_split_where_they_meet_an_aggregate(spark, docs, monkeypatch):
    """Rows without id and text, and a gram that very many documents hold: every join to an aggregate is over a stored one."""
    from rollcall.operators import joins
    from tests.conftest import plan

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    passage = "\n".join(prose(900 + i, 12) for i in range(6))
    rows = [(i, prose(i, 30) + "\n" + passage) for i in range(60)] + [(None, None)] * 60_000
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        out = dedup_lines(docs(rows, 12), count="gone")
        found = out.collect()
        assert sum(r.gone == 6 for r in found) == 59 and len(found) == 60_060
        assert "skew=true" in plan(out)
    finally:
        for key in settings:
            spark.conf.unset(key)
