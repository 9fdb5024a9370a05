"""Digests of results tell what is the same, whatever the partitions, and what isn't."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators.digest import Digest, Key, digest
from tracewright.operators.evaluate import differing_rows, normal_rows, same_rows

KEY = Key(11, 22, 333333)


@pytest.fixture(scope="module")
def million(spark):
    """A million rows with many repeats."""
    return spark.range(1_000_000, numPartitions=7).selectExpr("id * 7919 % 1000003 % 5000 AS x", "id % 3 AS y")


def test_a_million_rows(spark, million):
    rows = normal_rows(million)
    again = normal_rows(spark.range(1_000_000, numPartitions=3).selectExpr("id * 7919 % 1000003 % 5000 AS x", "id % 3 AS y"))
    a, b = digest(rows, KEY, 3), digest(again, KEY, 3)
    assert a == b and a.count == 1_000_000 and len(a.head) == 3 and a.head[0] == ("0", "0")
    one = normal_rows(spark.range(1_000_000, numPartitions=5).selectExpr("IF(id = 777777, -1, id * 7919 % 1000003 % 5000) AS x", "id % 3 AS y"))
    c = digest(one, KEY)
    assert not c.same(a, True) and not c.same(a, False)
    at = "CASE id WHEN 10 THEN 999990 WHEN 999990 THEN 10 ELSE id END"
    swapped = normal_rows(spark.range(1_000_000, numPartitions=5).selectExpr(f"({at}) * 7919 % 1000003 % 5000 AS x", f"({at}) % 3 AS y"))
    d = digest(swapped, KEY)
    assert d.same(a, False) and not d.same(a, True)


def test_repeats_count(spark):
    make = lambda *v: normal_rows(spark.createDataFrame([(x,) for x in v], "x string"))
    assert not same_rows(make("a", "a", "b"), make("a", "b", "b"), False)
    assert same_rows(make("a", "b", "a"), make("b", "a", "a"), False) and not same_rows(make("a", "b", "a"), make("b", "a", "a"), True)
    # equal sums of positions of each row
    assert not same_rows(make("a", "b", "b", "a"), make("b", "a", "a", "b"), True)
    off = {tuple(r["row"]): (r["pred_times"], r["gold_times"]) for r in differing_rows(make("a", "a", "b"), make("a", "b", "b", None), False).collect()}
    assert off == {("a",): (2, 1), ("b",): (1, 2), ("<null>",): (0, 1)}


def test_cells_dont_run_together(spark):
    two = lambda a, b: normal_rows(spark.createDataFrame([(a, b)], "a string, b string"))
    assert not same_rows(two("ab", "c"), two("a", "bc"), False)
    assert not same_rows(two("", "a"), normal_rows(spark.createDataFrame([("a",)], "a string")), False)


def test_no_rows(spark):
    none = normal_rows(spark.range(0).select("id"))
    assert digest(none, KEY, 5) == Digest() and same_rows(none, none, True)
    assert not same_rows(none, normal_rows(spark.range(1)), False)


def test_one_pass_without_shuffle_or_cache(spark, million):
    from tracewright.operators.evaluate import Executor

    million.where(F.col("x") < 50).createOrReplaceTempView("numbers")
    out = Executor(spark, timeout=60).execute("SELECT x, COUNT(*) FROM numbers GROUP BY x ORDER BY x")
    assert out.ok and out.count == 50 and out.digest.head[0][0] == "0"
    assert not out.rows.storageLevel.useMemory and not out.rows.storageLevel.useDisk
