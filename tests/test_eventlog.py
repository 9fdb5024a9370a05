"""Trace algebra on a tiny log: ties, repeated activities, nulls, midnight."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewright.operators import eventlog as E
from tracewright.sources.readers import EVENT_LOG


def at(text):
    return datetime.fromisoformat(text)


ROWS = [
    (1, "Start", at("2024-01-01 00:00:00"), "ann", 1.0, "c1"),
    (2, "Check", at("2024-01-01 08:00:00"), None, None, "c1"),
    (3, "Check", at("2024-01-01 08:00:00"), "bob", 5.0, "c1"),
    (4, "End", at("2024-01-02 00:00:00"), "ann", 2.5, "c1"),
    (5, "start", at("2024-01-03 10:00:00"), "ann", None, "c2"),
    (6, "Check", at("2024-01-03 11:00:00"), "ann", None, "c2"),
    (7, "End", at("2024-02-01 00:00:00"), None, None, "c2"),
    (8, "Start", at("2023-12-31 23:59:59"), None, 7.0, "c3"),
    (9, "Check", at("2024-01-01 00:00:01"), None, 7.0, None),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, EVENT_LOG)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def test_predicates(log):
    assert ids(log.where(E.has_activity("Start"))) == [1, 8]
    assert ids(log.where(E.activity_starts_with("sta"))) == [1, 5, 8]
    assert ids(log.where(E.activity_matches("HEC"))) == [2, 3, 6, 9]
    assert ids(log.where(E.resource_undefined())) == [2, 7, 8, 9]
    assert ids(log.where(F.col("resource") != "ann")) == [3]
    assert ids(log.where(E.cost_is("gte", 5.0))) == [3, 8, 9]


def test_time_includes_midnight(log):
    assert ids(log.where(E.in_month(2024, 1))) == [1, 2, 3, 4, 5, 6, 9]
    assert ids(log.where(E.on_day("2024-01-01"))) == [1, 2, 3, 9]
    assert ids(log.where(E.time_in("2024-01-01", "2024-01-02"))) == [1, 2, 3, 4, 9]
    assert ids(log.where(E.in_year(2023))) == [1, 8]  # the upper end is included


def test_month_range_is_pushed_down(log, tmp_path):
    path = str(tmp_path / "log")
    log.write.parquet(path)
    df = log.sparkSession.read.parquet(path).where(E.in_month(2024, 1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan


def test_first_and_last_break_ties_by_id(log):
    assert ("c1", "Start") in values(E.first_event(log, "activity"))
    assert ("c1", "End") in values(E.last_event(log, "activity"))
    steps = {(r["id"], r["next_activity"]) for r in E.following(log, "activity").collect()}
    assert {(1, "Check"), (2, "Check"), (3, "End"), (4, None)} <= steps


def test_events_after_keeps_duplicates(log):
    rows = values(E.events_after(log, "Check", "idcase", "id"))
    assert rows == [("c1", 4), ("c1", 4), ("c2", 7)]
    assert values(E.events_after_count(log, "Check")) == [("c1", 2), ("c2", 1)]


def test_precedes_and_elapsed(log):
    assert values(E.precedes(log, "Start", "End")) == [("c1",)]
    assert values(E.elapsed_between(log, "Start", "End")) == [("c1", 86400)]


def test_ties_are_kept(log):
    top = values(E.top_ties(log.where("idcase is not null"), "idcase", F.count("*"), 2))
    assert top == [("c1", 4), ("c2", 3)]
    tied = values(E.top_ties(log, "activity", F.countDistinct("idcase"), 1))  # a null case isn't counted
    assert tied == [("Check", 2), ("End", 2), ("Start", 2)]


def test_sole_resource_ignores_nulls(log):
    assert values(E.solely_by(log, "ann")) == [("c2", "ann")]


def test_membership(log):
    assert values(E.all_cost_null(log)) == [("c2",)]
    assert values(E.lacks(log, E.has_activity("End"))) == [("c3",)]
    assert values(E.excludes(log, E.activity_matches("start"), E.has_activity("End"))) == [("c3",)]
    assert values(E.consecutive_repeat(log)) == [("c1",)]
    assert values(E.consecutive_repeat(log, other_resource=True)) == []  # a null resource differs from nothing


def test_variants_and_rework(log):
    assert ("Start,Check,Check,End", 1) in values(E.variants(log))
    assert ("c1", 1) in values(E.rework(log))


def test_union_counts_once(log):
    rows = values(E.union_of(log, a=E.has_activity("Start"), b=E.cost_is("gt", 100.0)))
    assert rows == [(0, "b"), (2, "a")]


def test_empty_log(log):
    none = log.limit(0)
    assert E.directly_follows(none).count() == 0
    assert E.top_ties(none, "activity", F.count("*"), 3).count() == 0
    assert E.variants(none).count() == 0
