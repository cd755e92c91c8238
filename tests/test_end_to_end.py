"""From CSV files to every result, as in the README."""

from conftest import rows

from rollcall import Cleaning, Participation, collate
from rollcall.columns import rename_resolved
from rollcall.operators.rows import transcripts
from rollcall.sinks import dated_path, write_csv, write_report
from rollcall.sources.csv import read_csv

ONE = """ResponseID,ParticipantID,Prompt_ID,QuestionsType,Response,RespondedAt,Date,Reference,Transcript
r1,p1,q1,end_time,2025-08-14T10:00,t1,2025-08-14T10:05,,
r2,p1,q1,end_time,2025-08-14T10:00,t1,2025-08-14T10:01,,
r3,2,q1,textaudio,,2025-08-14T11:00,2025-08-14T11:01,ref,"said ""hi"", left"
"""
TWO = """ParticipantID,ResponseID,QuestionsType,Response,RespondedAt,Date
p1,r1,end_time,2025-08-14T10:00,t1,2025-08-14T10:09
2,r4,end_time,2025-08-15T08:00,,2025-08-15T08:01
2,r5,Incentives,"5, cash",,2025-08-15T08:02
"""


def test_files_to_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text(ONE)
    (tmp_path / "in/2.csv").write_text(TWO)
    merged = collate(spark, [str(tmp_path / "in"), str(tmp_path / "missing.csv")])
    assert tuple(merged.stats.first()) == (6, 1, 5)
    path = dated_path(str(tmp_path / "data.csv"), "2025-08-16")
    write_csv(merged.df, path)
    assert rows(read_csv(spark, path), "ResponseID") == [(f"r{i}",) for i in range(1, 6)]

    done = Participation(merged.df)
    assert [tuple(r) for r in done.summary().collect()] == [("2", 1, "5, cash", 1, 0), ("p1", 2, None, 0, 2)]
    assert [tuple(r) for r in done.audio().collect()] == [("2", 1, 0, 1)]
    assert done.stats().first().totalEntries == 3
    assert [(r.date, r.entries) for r in done.chart(n=1).collect()] == [("2025-08-15", 1)]
    assert rows(done.view("1days"), "ParticipantID", "n") == [("2", 1)]
    write_report(done.summary(), done.audio(), str(tmp_path / "report"))
    assert read_csv(spark, str(tmp_path / "report/summary")).columns == [
        "ParticipantID", "TotalEntries", "2025-08-15", "2025-08-14",
    ]

    tidy = Cleaning(rename_resolved(merged.df))
    assert rows(tidy.cleaned(), "ResponseID") == [("r2",), ("r3",), ("r4",), ("r5",)]
    assert [(r.Status, r.ResponseID) for r in tidy.review().collect()] == [("Kept (earliest)", "r2"), ("Removed", "r1")]
    assert tuple(tidy.stats().first()) == (5, 1, 1, 4)
    assert rows(transcripts(merged.df)) == [("2025-08-14T11:01", "ref", 'said "hi", left')]
