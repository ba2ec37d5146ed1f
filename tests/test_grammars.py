"""Reviewed grammars and read-only queries."""

import dataclasses

import pytest

from tidelog.sources import grammars, readonly
from tidelog.sources.grammars import LineGrammar

A = LineGrammar("a", 1, ("year", "=-", "month", "=-", "day", "= ", "hour", "=:", "minute", "=:", "second", "=,", "millis"), ("space", "level", "space", ("thread", "[", "]"), "space", ("logger", None, None), ("literal", " - "), "message"), priority=1, paths=("app*.log",))
B = LineGrammar("b", 2, ("day", "=/", "month", "=/", "year", "= ", "hour", "=:", "minute", "offset"), ("space", "message"), continued=False)


def test_problems():
    change = dataclasses.replace
    assert grammars.problems(A) == grammars.problems(B) == []
    assert grammars.problems(change(A, format_id=" ", version=0)) == ["identifier_invalid", "version_invalid"]
    assert grammars.problems(change(A, time=("year", "month"))) == ["timestamp_incomplete"]
    assert grammars.problems(change(B, time=(*B.time, "millis"))) == ["timestamp_invalid"]
    assert grammars.problems(change(A, layout=("message", "level"))) == ["message_misplaced"]
    assert grammars.problems(change(A, layout=("level", "space", "level", "message"))) == ["slot_twice"]
    assert grammars.problems(change(A, layout=(("logger", "[", None), "message"))) == ["layout_invalid"]
    assert grammars.problems(change(A, paths=("../x",), zone="Nowhere/Land")) == ["path_invalid", "zone_invalid"]
    with pytest.raises(ValueError):
        grammars.pattern(change(A, version=0))


LINES = [
    "before all", "2024-02-29 03:04:05,006 WARN [main] org.app - hello\t there", "  more", "2023-02-29 03:04:05,006 WARN [main] org.app - no such day", "2024-02-29 24:04:05,006 WARN [main] org.app - no such hour",
    "x" * 70_000, "2024-02-29 03:04:60,006 INFO [] l -  ", "2024-02-29 03:04:05,006  ERROR [a b] l - m",
]


def lines(spark, sources):
    return spark.createDataFrame([(s, i, x) for s, xs in sources.items() for i, x in enumerate(xs)], "source string, line_no long, line string")


@pytest.mark.parametrize("block", [2, 65_536])
def test_records(spark, block, monkeypatch):
    monkeypatch.setattr(grammars, "BLOCK", block)
    got = [tuple(r) for r in grammars.assembled(lines(spark, {"s": LINES}), A).orderBy("start_line").collect()]
    assert got == [
        ("s", 1, "2024-02-29 03:04:05,006", None, "WARN", "org.app", "main", "hello\t there", "\n".join([LINES[2], LINES[3], LINES[4]]), 3, 0),
        ("s", 6, "2024-02-29 03:04:60,006", None, "INFO", "l", "", "", "", 0, 0), ("s", 7, "2024-02-29 03:04:05,006", None, "ERROR", "l", "a b", "m", "", 0, 0),
    ]
    assert [r.line_no for r in grammars.unattributed(lines(spark, {"s": LINES}), A).orderBy("line_no").collect()] == [0, 5]
    many = {"s": [LINES[1]] + ["y"] * 600, "t": ["01/02/2024 03:04+02:30 b", "y", "01/02/2024 03:04Z"]}
    (r,) = grammars.assembled(lines(spark, many).where("source = 's'"), A).collect()
    assert (r.n_continued, r.lines_dropped, len(r.continuation)) == (512, 88, 512 * 2 - 1)
    got = grammars.assembled(lines(spark, many).where("source = 't'"), B).collect()
    assert [(r.start_line, r.ts, r.message, r.n_continued) for r in got] == [(0, 1706747640, "b", 0)]
    assert grammars.assembled(lines(spark, {}), A).count() == 0


def test_selection(spark):
    other = dataclasses.replace(A, format_id="c", paths=())
    sources = {"x/app.log.1": [LINES[1]] * 2, "app2.log": ["z", "z", "z", LINES[1]], "web.log": [LINES[1]], "t": ["01/02/2024 03:04+02:00 b"], "none": ["z"]}
    rows = lines(spark, sources)
    told = lambda gs: {r.source: (r.outcome, r.format_id, r.version) for r in grammars.selected(rows, gs).collect()}
    none = ("no_match", None, None)
    assert told([A, B, dataclasses.replace(A, format_id="bad", version=0)]) == {"x/app.log.1": ("selected", "a", 1), "app2.log": none, "web.log": none, "t": ("selected", "b", 2), "none": none}
    assert told([A, other])["x/app.log.1"] == ("conflict", "a,c", None)
    assert told([dataclasses.replace(A, priority=9), other])["x/app.log.1"] == ("selected", "a", 1)
    assert set(told([]).values()) == {none}


def test_only_queries_over_given_tables(spark):
    tables = {"events": spark.range(200).selectExpr("id AS seq", "repeat('x', 300) AS message"), "Names": spark.range(3)}
    got = readonly.answer(tables, "WITH e AS (SELECT * FROM events WHERE seq > 10) SELECT seq, message, seq AS seq FROM e JOIN names ON id = seq % 3 ORDER BY 1;", 60)
    assert got.columns == ["seq", "message", "seq"] and len(got.rows) == 50 and got.truncated and got.rows[0] == ("11", "x" * 200, "11")
    assert readonly.answer(tables, "select count(*) n from events where seq in (select id from names)", 60).rows == [("3",)]
    spark.range(1).createOrReplaceTempView("secret")
    for sql in (
        "", "drop view secret", "insert into events select 1, 'a'", "with x as (select 1) insert into events select 1, 'a'", "select 1; select 2", "set spark.a=b", "select * from secret", "select * from parquet.`/tmp/x`", "create table t as select 1", "refresh table events",
        "select transform(seq) using 'cat' from events", "select reflect('java.lang.System', 'exit', 0)", "select (select max(id) from secret)", "select * from events where exists (select 1 from secret)", "describe events", "explain select 1", "cache table events", "delete from events", "update events set seq = 1", "call x()",
    ):
        with pytest.raises(readonly.Refused):
            readonly.query(tables, sql)
    with pytest.raises(TimeoutError):
        readonly.answer({"events": spark.range(1 << 40)}, "select sum(id * 7 % 13) from events", 1)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_")]
    spark.catalog.dropTempView("secret")
