"""Comparisons without case as lists: the same rows, and filters that reach the files."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions.dialect import to_spark
from tracewright.functions.vocabulary import Vocabulary
from tracewright.operators.evaluate import Executor
from tracewright.sources.readers import EVENT_LOG, event_log

NAMES = ["Start Trip", "start trip", "END trip", "Check", "it's", "100%_a\\b", None, "Über"]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log.parquet")
    rows = [(i, NAMES[i % len(NAMES)], None, f"R{i % 3}", None, f"c{i}") for i in range(80)]
    spark.createDataFrame(rows, EVENT_LOG).write.parquet(path)
    read = event_log(spark, path)
    read.createOrReplaceTempView("event_log")
    return read


@pytest.fixture(scope="module")
def known(log):
    return Vocabulary.of(log, "activity", "resource", "idcase", most=50)


def pushed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_small_columns_are_listed(known):
    assert set(known.values) == {"activity", "resource"} and len(known.values["activity"]) == 7


@pytest.mark.parametrize("text", ["START TRIP", "it's", "none of these", "100%_a\\b", "über", ""])
def test_equality(log, known, text):
    got, want = log.where(known.equals("activity", text)), log.where(F.lower("activity") == text.lower())
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("pattern", ["%TRIP", "s%", "%'%", "_heck", "%", "zzz%", "%ü%"])
def test_patterns(log, known, pattern):
    got, want = log.where(known.like("activity", pattern)), log.where(F.ilike(F.col("activity"), F.lit(pattern)))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    no, other = log.where(~known.like("activity", pattern)), log.where(~F.ilike(F.col("activity"), F.lit(pattern)))
    assert no.exceptAll(other).isEmpty() and other.exceptAll(no).isEmpty()


def test_filters_reach_the_files(log, known):
    plan = pushed(log.where(known.like("activity", "%trip")))
    assert "PushedFilters: [In(activity, [END trip,Start Trip,start trip])]" in plan
    assert "In(" not in pushed(log.where(known.like("idcase", "C1%")))


@pytest.mark.parametrize(
    ("where", "same"),
    [
        ("activity = 'CHECK'", "lower(activity) = 'check'"),
        ("activity <> 'CHECK'", "lower(activity) <> 'check'"),
        ("activity NOT LIKE '%TRIP'", "activity NOT ILIKE '%trip'"),
        ("activity != 'nothing'", "activity IS NOT NULL"),
        ("activity = 'nothing' OR resource LIKE 'r1'", "resource = 'R1'"),
        ("activity = 'it''s'", "activity = \"it's\""),
        ("e.activity = 'Check'", "activity = 'Check'"),
        ("idcase LIKE 'C7'", "idcase = 'c7'"),
    ],
)
def test_statements(spark, log, known, where, same):
    out = Executor(spark, timeout=60, known=known).execute(f"SELECT id FROM event_log e WHERE {where}")
    assert out.ok, out.error
    assert {int(r["row"][0]) for r in out.rows.collect()} == {r["id"] for r in log.where(same).select("id").collect()}


def test_without_known_values_nothing_changes():
    assert to_spark("SELECT id FROM event_log WHERE activity = 'CHECK'") == "SELECT id FROM event_log WHERE activity = 'CHECK'"
