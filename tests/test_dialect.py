"""SQLite forms run on Spark and mean the same."""

from datetime import datetime

import pytest

from tracewright.functions import dialect as D
from tracewright.operators.evaluate import Executor, differing_rows, execution_match, normal_rows, same_rows
from tracewright.sources.readers import EVENT_LOG, register

ROWS = [
    (1, "Start trip", datetime(2018, 1, 1, 8), "ann", 1.0, "c1"),
    (2, "End trip", datetime(2018, 1, 3, 8), "bob", 5.0, "c1"),
    (3, "Start trip", datetime(2018, 2, 1), "ann", None, "c2"),
    (4, "Check", datetime(2018, 2, 2), None, 2.0, "c2"),
]


@pytest.fixture(scope="module")
def run(spark):
    register(spark.createDataFrame(ROWS, EVENT_LOG))

    def call(sql):
        return sorted(tuple(r) for r in spark.sql(D.to_spark(sql)).collect())

    return call


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT COUNT (*) FROM event_log WHERE activity LIKE '%TRIP%'", [(3,)]),
        ("SELECT idcase, strftime('%s', MAX(timestamp)) - strftime('%s', MIN(timestamp)) FROM event_log GROUP BY idcase", [("c1", 172800), ("c2", 86400)]),
        ("SELECT COUNT(*) as 'how many' FROM event_log WHERE strftime('%Y-%m', timestamp) = '2018-02'", [(2,)]),
        ("SELECT activity FROM (SELECT idcase, activity, MIN(timestamp) FROM event_log GROUP BY idcase)", [("Start trip",), ("Start trip",)]),
        ("SELECT idcase, activity, MAX(timestamp) FROM event_log GROUP BY idcase", [("c1", "End trip", datetime(2018, 1, 3, 8)), ("c2", "Check", datetime(2018, 2, 2))]),
        ("SELECT idcase FROM event_log GROUP BY idcase HAVING COUNT(DISTINCT resource) = 1 AND resource = 'ann'", [("c2",)]),
        ("SELECT idcase, julianday(MAX(timestamp)) - julianday(MIN(timestamp)) FROM event_log GROUP BY idcase", [("c1", 2.0), ("c2", 1.0)]),
        ("SELECT idcase, GROUP_CONCAT(activity, '>' ORDER BY timestamp) FROM event_log GROUP BY idcase", [("c1", "Start trip>End trip"), ("c2", "Start trip>Check")]),
        ("SELECT idcase, GROUP_CONCAT(activity ORDER BY timestamp DESC) FROM event_log GROUP BY 1", [("c1", "End trip,Start trip"), ("c2", "Check,Start trip")]),
        ("SELECT idcase, activity, MAX(timestamp) FROM event_log GROUP BY 1", [("c1", "End trip", datetime(2018, 1, 3, 8)), ("c2", "Check", datetime(2018, 2, 2))]),
        ("SELECT COUNT(*) FROM event_log WHERE activity = (SELECT activity FROM event_log GROUP BY activity)", [(1,)]),
        ("SELECT COUNT(*) FROM event_log WHERE id >= (SELECT id FROM event_log WHERE idcase = 'c2' ORDER BY id DESC)", [(1,)]),
        ("SELECT id FROM event_log WHERE cost = (SELECT MAX(cost) FROM event_log)", [(2,)]),
        ("SELECT strftime('%Y-%m-%dT%H:%M', timestamp) FROM event_log WHERE id = 1", [("2018-01-01T08:00",)]),
        ("SELECT CAST(date(timestamp, '+1 day') AS STRING) FROM event_log WHERE id = 1", [("2018-01-02",)]),
        ("SELECT CAST(date(timestamp, 'start of month', '-1 month') AS STRING) FROM event_log WHERE id = 4", [("2018-01-01",)]),
        ("SELECT strftime('%d', timestamp, '+2 days') FROM event_log WHERE id = 1", [("03",)]),
        ("SELECT activity FROM event_log GROUP BY activity HAVING COUNT(*) = (SELECT COUNT(*) FROM event_log GROUP BY activity ORDER BY COUNT(*) DESC LIMIT 1)", [("Start trip",)]),
        ("SELECT 1 UNION SELECT 2 INTERSECT SELECT 1", [(1,)]),
        ("SELECT ifnull(resource, 'none') FROM event_log WHERE id = 4", [("none",)]),
        ("SELECT resource FROM event_log WHERE resource = \"bob\"", [("bob",)]),
        ("SELECT count(*) FROM event_log WHERE timestamp LIKE '2018%'", [(4,)]),
    ],
)
def test_runs(run, sql, want):
    assert run(sql) == want


@pytest.mark.parametrize("sql", ["SELECT date(timestamp, 'weekday 0') FROM event_log", "SELECT strftime('%f', timestamp) FROM event_log", "SELECT julianday(timestamp, '+1 fortnight') FROM event_log"])
def test_what_is_not_understood_fails(run, sql):
    """An argument is never left out: a wrong answer would count as a right one."""
    with pytest.raises(Exception):
        run(sql)


def test_quotes_are_left_alone():
    assert "'a like b'" in D.to_spark("SELECT * FROM t WHERE x = 'a like b'")


@pytest.mark.parametrize("sql", ["DELETE FROM event_log", "DROP TABLE event_log", "SELECT 1; SELECT 2", "INSERT INTO event_log SELECT 1", ""])
def test_only_queries(sql):
    assert not D.is_query(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT x FROM a",
        "WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{}' USING parquet SELECT x FROM a",
        "WITH a AS (SELECT 1 AS x) FROM a INSERT INTO t SELECT x INSERT INTO t SELECT x",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM text.`/etc/hostname`",
        "CREATE TABLE t2 AS SELECT 1",
        "EXPLAIN SELECT 1",
    ],
)
def test_nothing_is_written_or_reached(run, spark, tmp_path, sql):
    spark.sql(f"CREATE TABLE IF NOT EXISTS t (x INT) USING parquet LOCATION '{tmp_path}/t'")
    try:
        for sqlite in (True, False):
            out = Executor(spark, timeout=60, sqlite=sqlite).execute(sql.format(f"{tmp_path}/out"))
            assert not out.ok and out.error == "not a single query statement"
        assert spark.table("t").count() == 0 and not (tmp_path / "out").exists()
    finally:
        spark.sql("DROP TABLE t")


def test_cells_as_text(spark):
    cells = [("-0.0", "0"), ("1e20", "100000000000000000000"), ("-2.0", "-2"), ("0.1234567", "0.123457"), ("inf", "inf"), ("-inf", "-inf"), ("nan", "nan")]
    rows = normal_rows(spark.createDataFrame([(i, float(x)) for i, (x, _) in enumerate(cells)], "i int, x double")).collect()
    assert {r["row"][0]: r["row"][1] for r in rows} == {str(i): text for i, (_, text) in enumerate(cells)}


def test_rows_in_order_over_several_partitions(spark):
    rows = lambda n, k: normal_rows(spark.range(n, numPartitions=k).selectExpr("id * 7 % 11 AS x")).cache()
    a = rows(50, 3)
    assert differing_rows(a, rows(50, 7), ordered=True).isEmpty()
    assert same_rows(a, rows(50, 7), ordered=True) and not same_rows(a, rows(51, 3), ordered=True)
    assert not same_rows(a, normal_rows(spark.range(50, numPartitions=3).selectExpr("(49 - id) * 7 % 11 AS x")).cache(), ordered=True)


def test_execution(run, spark):
    e = Executor(spark, timeout=60)
    assert e.execute("").error == "empty SQL"
    assert not e.execute("SELECT nope FROM event_log").ok
    gold = "SELECT activity FROM event_log ORDER BY id"
    same = e.execute("SELECT upper(activity) FROM event_log ORDER BY id")
    assert execution_match(same, e.execute(gold), gold)["score"] == 1
    shuffled = e.execute("SELECT activity FROM event_log ORDER BY id DESC")
    assert execution_match(shuffled, e.execute(gold), gold)["score"] == 0
    unordered = "SELECT activity FROM event_log"
    assert execution_match(shuffled, e.execute(unordered), unordered)["score"] == 1
    less = e.execute("SELECT DISTINCT activity FROM event_log")
    assert execution_match(less, e.execute(unordered), unordered)["score"] == 0
    assert execution_match(e.execute("SELECT 1"), e.execute("SELECT 1.0"), "SELECT 1.0")["score"] == 1
    assert execution_match(e.execute("SELECT NULL"), e.execute("SELECT '<null>'"), "")["score"] == 1


def test_timeout_is_an_error(run, spark):
    out = Executor(spark, timeout=2.0).execute("SELECT count(*) FROM range(0, 300000) a JOIN range(0, 300000) b ON a.id * b.id % 7 = 3")
    assert not out.ok and out.error.startswith("timeout")
