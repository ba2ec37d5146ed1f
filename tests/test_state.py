"""Revisions: writers in conflict, refused updates, undo, rules; and zones against zoneinfo."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from tidelog import state
from tidelog.shared import fresh_folder
from tidelog.sources import zones

EVENTS = "seq long, source string, ts long, message string"


def table(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture()
def events(spark):
    v = state.Versioned(spark, fresh_folder(spark, "events"))
    state.append(v, table(spark, [(1, "a", 10, "x"), (2, "a", None, "y"), (3, "b", 30, "z")]), 0)
    return v


def rows(v, revision=None):
    return sorted(tuple(r) for r in v.read(revision).collect())


def test_of_two_writers_one_is_refused(spark, events):
    late = state.Versioned(spark, events.path)
    assert late.revision() == 1
    state.append(events, table(spark, [(4, "b", 40, "n")]), 1)
    with pytest.raises(state.Conflict):
        state.append(late, table(spark, [(5, "b", 50, "n")]), 1)
    # Both saw the same revision and have written their data: only one may publish.
    first, second = (state.Commit(3, events.last().data, None, "append", {"by": n}) for n in "xy")
    events._publish(first)
    with pytest.raises(state.Conflict):
        late._publish(second)
    assert events.last().note == {"by": "x"} and len(rows(events)) == 4


def test_appended_events_are_new(spark, events):
    for batch in ([(1, "a", 1, "x")], [(7, "a", 1, "x"), (7, "a", 2, "x")], [(None, "a", 1, "x")]):
        with pytest.raises(state.Conflict):
            state.append(events, table(spark, batch), 1)
    assert events.revision() == 1


def test_times_all_or_none_and_undo(spark, events):
    update = lambda *r: spark.createDataFrame(r, "seq long, source string, expected_ts long, new_ts long")
    for bad in ([(1, "a", 10, 5), (1, "a", 10, 6)], [(1, "a", 11, 5)], [(1, "b", 10, 5)], [(9, "a", 10, 5)], [(1, "a", 10, 5), (3, "b", 31, 6)]):
        with pytest.raises(state.Conflict):
            state.apply_times(events, update(*bad), 1)
    before = rows(events)
    state.apply_times(events, update((1, "a", 10, 5), (2, "a", None, 7)), 1, {"zone": "UTC"})
    assert rows(events) == [(1, "a", 5, "x"), (2, "a", 7, "y"), (3, "b", 30, "z")]
    with pytest.raises(state.Conflict):
        events.undo(1)
    events.undo(2)
    assert rows(events) == before and rows(events, 2) != before
    with pytest.raises(state.Conflict):
        events.undo(3)
    assert [(r.revision, r.kind) for r in state.audit(events).collect()] == [(1, "append"), (2, "times"), (3, "undo")]


def test_rules(spark, events):
    v = state.Versioned(spark, fresh_folder(spark, "rules"))
    with pytest.raises(state.Conflict):
        state.activate_rule(v, "r", 1, "f", 0, events, 0)
    state.activate_rule(v, "r", 1, "f", 1, events, 0)
    for again in (("r", 2), ("q", 1)):
        with pytest.raises(state.Conflict):
            state.activate_rule(v, *again, "f", 1, events, 1)
    with pytest.raises(state.Conflict):
        state.change_rule(v, "r", "enable", 1)
    state.change_rule(v, "r", "disable", 1)
    with pytest.raises(state.Conflict):
        state.change_rule(v, "r", "enable", 1)
    state.change_rule(v, "r", "enable", 2)
    state.change_rule(v, "r", "remove", 3)
    with pytest.raises(state.Conflict):
        state.change_rule(v, "r", "enable", 4)
    state.activate_rule(v, "q", 1, "f", 1, events, 4)
    assert {r.rule_id: (r.state, r.changed_in) for r in v.read().collect()} == {"r": ("removed", 4), "q": ("enabled", 5)}
    v.undo(5)
    assert [r.rule_id for r in v.read().collect()] == ["r"]


def test_local_times_of_zones(spark):
    names = ["Australia/Lord_Howe", "America/Chicago", "Asia/Kolkata", "Europe/Dublin"]
    second = lambda *t: int(datetime(*t, tzinfo=UTC).timestamp())
    asked = [("Australia/Lord_Howe", second(2024, 4, 7, 1, 45), None), ("America/Chicago", second(2024, 11, 3, 1, 30), None), ("America/Chicago", second(2024, 11, 3, 1, 30), "cst"), ("America/Chicago", second(2024, 11, 3, 1, 30), "CDT"), ("America/Chicago", second(2024, 3, 10, 2, 30), None), ("America/Chicago", second(2024, 7, 1), "CST"), ("America/Chicago", second(2024, 11, 3, 1, 30), "EST"), ("Nowhere/Land", 0, None), ("Asia/Kolkata", None, None), ("Asia/Kolkata", second(1800, 1, 1), None)]
    want = ["fold", "fold", "resolved", "resolved", "gap", "mismatch", "mismatch", "unknown_zone", "no_time", "out_of_range"]
    # Every half hour around the changes of a year, against zoneinfo's own two readings of a local time.
    for zone in names:
        for month, day in ((3, 8), (3, 30), (4, 6), (10, 5), (10, 26), (11, 2)):
            for half in range(96):
                local = datetime(2024, month, day) + timedelta(minutes=30 * half)
                both = [local.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1)]
                real = sorted({b.astimezone(UTC) for b in both if b.astimezone(UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == local})
                asked.append((zone, int(local.replace(tzinfo=UTC).timestamp()), None))
                want.append(("gap", "resolved", "fold")[len(real)] + (f" {int(real[0].timestamp())}" if len(real) == 1 else ""))
    df = spark.createDataFrame([(i, z, t, a) for i, (z, t, a) in enumerate(asked)], "id long, zone string, local long, abbreviation string")
    got = {r.id: r for r in zones.resolved(df, zones.offsets(spark, names), "id").collect()}
    told = [got[i].reason + (f" {got[i].ts}" if " " in w else "") for i, w in enumerate(want)]
    assert told == want
    assert got[2].ts - got[3].ts == 3600
