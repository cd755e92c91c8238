"""Operators against plain Python over random small surveys."""

import random

import pytest
from conftest import rows

from rollcall.operators import cleaning as c
from rollcall.operators import dedup as d
from rollcall.operators import joins, ranges
from rollcall.operators import participation as p
from rollcall.plans.cleaning import Cleaning
from rollcall.plans.participation import Participation
from test_participation import COLUMNS

SEEDS = [1, 2]
DAYS = [f"2025-08-{n:02d}" for n in range(10, 16)]


def random_survey(seed, n=300):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.choice(["end_time", "end_time", "Incentives", "textaudio", "audio", "text"])
        time = r.choice(DAYS) + r.choice(["T10:00", "T9:00:01", "", " 11:00"])
        bad = r.choice(["", "garbage", "xT1", "Today", "2025-02-31"])
        response = {"end_time": r.choice([time] * 6 + [bad]), "Incentives": r.choice(["5", "7", "", time])}
        answered, date = r.choice([time, time, "", bad]), r.choice([time, "", bad])
        pid = r.choice(["1", "2", "10", "007", "ann", "bob", "hot", "hot", "hot", "hot", "4294967295"])
        out.append((pid, kind, response.get(kind, "x"), answered, date))
    return out


def day_of(text):
    """Day of the random texts above: the part before ``T``, or a readable date."""
    if "T" in text:
        return text.split("T")[0] or None
    head = text.split(" ")[0]
    return head if head in DAYS else None


def expected(data):
    entries, audio, latest, seen = {}, {}, {}, {}
    for place, (pid, kind, response, answered, date) in enumerate(data):
        if kind == "end_time" and day_of(response):
            cell = (pid, day_of(response))
            entries[cell] = entries.get(cell, 0) + 1
            seen.setdefault(pid, place)
        if kind in ("textaudio", "audio") and day_of(answered or date):
            cell = (pid, day_of(answered or date))
            audio[cell] = audio.get(cell, 0) + 1
        if kind == "Incentives" and response:
            when = answered or date or (response if "T" in response else "")
            if pid not in latest or when > latest[pid][0]:
                latest[pid] = (when, response)
    return entries, audio, latest, seen


def order_of(pids, seen):
    whole = [x for x in pids if x.isdigit() and str(int(x)) == x and int(x) < 4294967295]
    rest = [x for x in pids if x not in whole]
    return sorted(whole, key=int) + sorted(rest, key=seen.get)


@pytest.mark.parametrize("seed", SEEDS)
def test_participation(table, seed):
    data = random_survey(seed)
    entries, audio, latest, seen = expected(data)
    survey = table(COLUMNS, data)
    done = Participation(survey, order_by=["_row_ord"])

    assert rows(done.daily, "ParticipantID", "day", "n") == sorted(((*k, n) for k, n in entries.items()), key=repr)
    assert rows(done.audio_daily, "ParticipantID", "day", "n") == sorted(((*k, n) for k, n in audio.items()), key=repr)
    assert rows(p.daily_entries(survey)) == rows(done.daily, "ParticipantID", "day", "n")
    assert rows(p.daily_audio(survey)) == rows(done.audio_daily, "ParticipantID", "day", "n")

    pids = order_of({k[0] for k in entries}, seen)
    total = {x: sum(n for k, n in entries.items() if k[0] == x) for x in pids}
    days = sorted({k[1] for k in entries if k[1] in DAYS}, reverse=True)
    assert done.day_names == days
    wide = [(x, total[x], latest.get(x, (0, None))[1], *[entries.get((x, day), 0) for day in days]) for x in pids]
    assert [tuple(r) for r in done.summary().collect()] == wide
    given = p.summary_wide(done.daily, done.totals, done.incentive, days, sort=True)
    assert [tuple(r) for r in given.collect()] == wide

    voices = {k[0] for k in audio}
    loud = [(x, sum(n for k, n in audio.items() if k[0] == x), *[audio.get((x, day), 0) for day in days]) for x in voices]
    assert rows(done.audio()) == sorted(loud, key=repr)

    by_total = sorted(pids, key=lambda x: -total[x])
    active = [k for k in entries if k[1] in DAYS]
    s = done.stats().first()
    assert (s.totalParticipants, s.totalEntries, s.totalActiveDays) == (len(pids), sum(total.values()), len(active))
    assert (s.mostActiveParticipant.id, s.leastActiveParticipant.id) == (by_total[0], by_total[-1])
    assert s.avgEntriesPerParticipant == int(sum(total.values()) / len(pids) * 100 + 0.5) / 100
    assert s.avgDailyParticipation == int(len(active) / len(days) * 100 + 0.5) / 100

    chart = {day: sum(n for k, n in entries.items() if k[1] == day) for day in days}
    assert [(r.date, r.entries) for r in done.chart().collect()] == list(chart.items())
    own = {day: entries.get(("hot", day), 0) for day in days}
    assert [(r.date, r.entries) for r in done.chart("hot").collect()] == list(own.items())

    shown = days[:3]
    assert {day for day in DAYS if day >= shown[-1]} == set(shown)
    view = [(x, total[x], day, n) for (x, day), n in entries.items() if day in shown]
    got = ranges.summary_in_range(done.daily, done.totals, 3)
    assert rows(got, "ParticipantID", "TotalEntries", "day", "n") == sorted(view, key=repr)


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("require_date", [False, True])
def test_cleaning(table, monkeypatch, seed, limit, require_date):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    r = random.Random(seed)
    words = ["q1", "q2", "", "None", "null ", "q1"]
    data = [
        (r.choice(words), r.choice(["p", "p", "P", "undefined"]), r.choice(["t1", "t2"]), r.choice(["a1", "a2", "", "b"]))
        for _ in range(80)
    ]
    df = table(("PromptID", "ParticipantID", "RespondedAt", "Date"), data)

    def blank(text):
        return text.strip().lower() in ("", "none", "null", "undefined")

    groups = {}
    for place, row in enumerate(data, 1):
        if not any(map(blank, row[:3])) and not (require_date and blank(row[3])):
            groups.setdefault(row[:3], []).append((row[3], place))
    removed = sorted(place for g in groups.values() for _, place in sorted(g)[1:])
    kept = sorted(set(range(1, len(data) + 1)) - set(removed))
    many = {k: g for k, g in groups.items() if len(g) > 1}
    done = Cleaning(df, order_by=["_row_ord"], require_date=require_date)

    assert [x[0] for x in sorted(rows(done.cleaned(), "_row_ord"))] == kept
    assert [x[0] for x in sorted(rows(done.removed(), "_row_ord"))] == removed
    assert tuple(done.stats().first()) == (len(data), len(many), len(removed), len(kept))
    sizes = sorted(((*k, len(g), len({x for x, _ in g}), min(y for _, y in g)) for k, g in many.items()), key=repr)
    assert rows(done.groups()) == sizes
    review = [(x.Status, x._row_ord) for x in done.review(None).collect()]
    in_order = sorted(many.values(), key=lambda g: min(y for _, y in g))
    assert review == [
        (c.REMOVED if i else c.KEPT, place) for g in in_order for i, (_, place) in enumerate(sorted(g))
    ]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedup(table, seed, keep):
    r = random.Random(seed)
    data = [(r.choice(["", None, "a", "b", "c"]), r.choice(["", "x"])) for _ in range(60)]
    df = table(("k", "v"), data)
    pick = (lambda places: places[0]) if keep == "first" else (lambda places: places[-1])

    def places_of(key_of):
        groups = {}
        for place, row in enumerate(data, 1):
            groups.setdefault(key_of(row), []).append(place)
        return groups

    one = places_of(lambda row: row[0] or "")
    got = [x[0] for x in sorted(rows(d.dedup(df, ["k"], ["_row_ord"], keep), "_row_ord"))]
    assert got == sorted(pick(g) for g in one.values())
    spared = d.dedup(df, ["k"], ["_row_ord"], keep, "keep")
    wanted = one[""] + [pick(g) for k, g in one.items() if k]
    assert [x[0] for x in sorted(rows(spared, "_row_ord"))] == sorted(wanted)
    whole = places_of(lambda row: (row[0] or "", row[1]))
    assert [x[0] for x in sorted(rows(d.dedup(df, None, ["_row_ord"], keep), "_row_ord"))] == sorted(
        pick(g) for g in whole.values()
    )
    assert tuple(d.dedup_stats(df, ["k"]).first()) == (60, 60 - len(one), len(one))
