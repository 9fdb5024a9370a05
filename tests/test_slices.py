"""Order inside large cases: the same as by one window, over more than one task."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators import eventlog as E
from tracewright.operators import slices

HOT = 12_000


@pytest.fixture(scope="module")
def log(spark):
    """Half of all events are of one case; some are of a null case, some of one instant, some without activity."""
    case = F.when(F.col("id") < HOT, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("id") % 997))
    second = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 10_007)
    activity = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(4))))
    rows = spark.range(2 * HOT, numPartitions=6).select("id", case.alias("idcase"), activity.alias("activity"), F.timestamp_seconds(second).cast("timestamp_ntz").alias("timestamp"), F.lit("mine").alias("other"))
    return rows.cache()


@pytest.mark.parametrize("step", [1, 2, 5])
@pytest.mark.parametrize("rows", [1, 40, 1000, 10**9])
def test_following_is_the_window(log, step, rows):
    order = W.partitionBy("idcase").orderBy("timestamp", "id")
    want = log.select("id", F.lead("activity", step).over(order).alias("next_activity"), F.lead("timestamp", step).over(order).alias("next_timestamp"))
    got = E.following(log, "activity", "timestamp", step=step, slice_rows=rows)
    assert got.columns == [*log.columns, "next_activity", "next_timestamp"]
    got = got.select(want.columns)
    assert got.count() == 2 * HOT and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("rows", [1, 100, 10**9])
def test_places(log, rows):
    want = log.select("id", (F.row_number().over(W.partitionBy("idcase").orderBy("timestamp", "id")) - 1).cast("long").alias("place"))
    got = slices.placed(log, "idcase", rows=rows).select("id", "place")
    assert got.count() == 2 * HOT and got.exceptAll(want).isEmpty()


def test_a_hot_case_is_in_several_tasks(spark, log):
    cut = slices.sliced(log, "idcase", rows=500)
    sizes = {r["__slice"]: r["count"] for r in cut.where("idcase = 'hot'").groupBy("__slice").count().collect()}
    assert len(sizes) > 12 and max(sizes.values()) < 3 * 500
    assert cut.where("idcase like 'c%' and __slice is not null").isEmpty()
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        tasks = slices.following(log, "activity", case="idcase", rows=500).where("idcase = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set(coalesce, before)
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < HOT


@pytest.mark.parametrize("rows", [None, 1, 300, 10**9])
def test_variants(spark, log, rows):
    few = log.where("id >= 12000 and idcase is not null and activity is not null").union(log.where("id >= 12000 and id < 12040").withColumn("idcase", F.concat(F.lit("x"), F.col("id") % 8)))
    want = E.trace(few).groupBy(F.array_join("trace", ",").alias("variant")).agg(F.count("*").alias("cases"))
    got = E.variants(few, slice_rows=rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_fingerprints_tell_order_and_length(spark):
    traces = ["ab", "ba", "abb", "bab", "aab", "a", "abab", "baba", ""]
    rows = [(f"{i}-{k}", n, c) for i, t in enumerate(traces) for k in range(2) for n, c in enumerate(t)]
    log = spark.createDataFrame(rows, "idcase string, id long, activity string").withColumn("timestamp", F.lit("2020-01-01").cast("timestamp_ntz"))
    found = {r["idcase"]: (r["length"], r["one"], r["two"]) for r in E.fingerprints(log).collect()}
    assert len(set(found.values())) == len(traces) - 1 and all(found[f"{i}-0"] == found[f"{i}-1"] for i in range(len(traces) - 1))


def test_empty_log(log):
    none = log.limit(0)
    assert E.following(none, "activity", slice_rows=1).count() == 0 and E.variants(none).count() == 0


@pytest.mark.parametrize("rows", [None, 1, 60])
def test_pairs_in_cases(log, rows):
    some = log.where("id < 400 or id >= 23000").withColumn("activity", F.coalesce("activity", F.lit("none")))
    a, b = some.alias("a"), some.where("activity = 'a1'").alias("b")
    for got, sign in ((E.events_after(some, "a1", "id", slice_rows=rows), ">"), (E.events_before(some, "a1", "id", slice_rows=rows), "<")):
        want = a.join(b, F.expr(f"a.idcase = b.idcase and a.timestamp {sign} b.timestamp")).select("a.id")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 1000
    want = a.join(b, F.expr("a.idcase = b.idcase and a.timestamp > b.timestamp and a.activity = 'a2'")).select(F.col("a.idcase"), (E.seconds("a.timestamp") - E.seconds("b.timestamp")).alias("elapsed"))
    got = E.elapsed_between(some, "a1", "a2", slice_rows=rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
