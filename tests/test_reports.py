"""Nulls, ties and empty tables of the small reports."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import reports
from tidelog.operators.filters import EventFilter

SCHEMA = "seq long, ts long, source string, template_id long, message string, basis string"
ROWS = [(1, 5, "a", 1, "an error x", "explicit_wall"), (2, None, "a", None, "fine", None), (3, 9, "b", None, None, "order_only"), (4, 7, None, 2, "error", "resolved_local")]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups_with_nulls(events):
    assert rows(reports.reduction(events, "source")) == [("a", 2.0), ("b", None), (None, 1.0)]
    assert len(rows(reports.confidence(events, "source", F.col("basis"), F.col("ts")))) == 4
    assert rows(reports.reduction(events.limit(0), "source")) == []


def test_pages_and_rankings(events):
    assert [tuple(r) for r in reports.with_total(events.select("ts", "seq"), ["ts", "seq"], 2).collect()] == [(None, 2, 4), (5, 1, 4)]
    assert reports.with_total(events.limit(0), ["ts"], 2).count() == 0
    ranked = reports.ranked_sources(events.where("source is not null"), F.col("message").contains("error"), ["b"], 5)
    assert [tuple(r) for r in ranked.collect()] == [("b", 20), ("a", 15)]
    assert reports.ranked_sources(events, F.lit(True), [], 1).count() == 1
    assert [r.seq for r in reports.stale(events, F.lit(True), "ts", F.lit(7), "seq").collect()] == [1, 4]


def test_expressions(spark, events):
    one = events.limit(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(reports.in_gaps(F.lit(5), [(1, 2), (5, 6)])) and not value(reports.in_gaps(F.lit(3), [(1, 2), (5, 6)])) and value(reports.in_gaps(F.lit(3), [])) is False
    assert value(reports.in_gaps(F.lit(None).cast("long"), [(1, 2)])) is None
    assert (value(reports.clamped(F.lit(9), 1, 3)), value(reports.clamped(F.lit(None).cast("long"), 1, 3))) == (3, None)
    assert value(reports.parameters(F.lit("k=1 of 2"), F.lit("<*> of <*>"))) == ["k=1", "2"] and value(reports.parameters(F.lit("a b c"), F.lit("<*> b"))) is None
    assert value(reports.shared_sources(F.array(F.lit("b"), F.lit("a"), F.lit("b")), ["b", "c", "a"])) == ["a", "b"] and value(reports.shared_sources(F.array(F.lit("b")), [])) == []
    assert rows(EventFilter(wall_only=True).apply(events).select("seq")) == [(1,), (4,)]
    assert rows(reports.uncovered(events.select("seq"), spark.createDataFrame([(1,), (None,)], "seq long"), "seq")) == [(2,), (3,), (4,)]
    assert reports.worth_review(spark.createDataFrame([(70, 30), (69, 99), (None, 50)], "confidence long, salience long")).count() == 1
