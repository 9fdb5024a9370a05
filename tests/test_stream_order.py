"""Events in any order within the delay give what the batch operators give; state goes once the watermark has passed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import eventlog as E
from tracewright.sources.readers import EVENT_LOG
from tracewright.streaming import order as S

START = datetime(2024, 1, 1)


def events(n=300):
    random.seed(9)
    out = []
    for i in range(n):
        at = START + timedelta(seconds=random.choice([40, 40.5, 90]) * (i // 2), microseconds=i % 3)
        out.append((i, random.choice("abc"), at, random.choice(["ann", "bob", None]), None, f"c{i % 5}"))
    return out


@pytest.fixture(scope="module")
def rocks(spark):
    changed = {"spark.sql.streaming.stateStore.providerClass": S.ROCKS, "spark.sql.shuffle.partitions": "2"}
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def run(spark, tmp_path, batches, make):
    """Each batch a file, each file a micro-batch; the last batch only moves the watermark."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT_LOG).coalesce(1).write.mode("append").parquet(str(folder / f"b{k:03}"))
    stream = spark.readStream.schema(EVENT_LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = make(stream).writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("ordered"), query


def shuffled(rows, size):
    """In batches by time; within a batch and its neighbour in any order."""
    rows = sorted(rows, key=lambda r: r[2])
    mixed = [r for at in range(0, len(rows), 2 * size) for r in random.sample(rows[at : at + 2 * size], len(rows[at : at + 2 * size]))]
    return [mixed[at : at + size] for at in range(0, len(mixed), size)]


def test_any_order_gives_the_batch_result(rocks, tmp_path):
    rows = events()
    end = [(10_000 + k, "z", START + timedelta(days=40 + k), None, None, "end") for k in range(2)]
    out, query = run(rocks, tmp_path, [*shuffled(rows, 75), [end[0]], [end[1]]], lambda s: S.following(s, "activity", delay="2 hours", quiet="10 days"))
    got = {(r["idcase"], r["id"], r["timestamp"], r["activity"], r["next_id"], r["next_activity"], r["next_timestamp"]) for r in out.where("idcase <> 'end'").collect()}
    log = rocks.createDataFrame(rows, EVENT_LOG)
    want = {(r["idcase"], r["id"], r["timestamp"], r["activity"], r["next_id"], r["next_activity"], r["next_timestamp"]) for r in E.following(log, "id", "activity", "timestamp").collect()}
    assert len(want) == len(rows) and got == want
    ids = [r["id"] for r in out.where("idcase = 'c1'").collect()]
    order = [r["id"] for r in log.where("idcase = 'c1'").orderBy("timestamp", "id").collect()]
    assert ids == order
    # of all ended cases nothing is left
    state = rocks.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "cp"))
    assert state.where("key.idcase <> 'end'").isEmpty()


def test_pairs_and_repeats(rocks, tmp_path):
    rows = events(120)
    end = [[(10_000 + k, "z", START + timedelta(days=40 + k), None, None, "end")] for k in range(2)]
    log = rocks.createDataFrame(rows, EVENT_LOG)
    out, _ = run(rocks, tmp_path, [*shuffled(rows, 40), *end], lambda s: S.directly_follows(s, delay="2 hours", quiet="10 days"))
    got = {(r["activity"], r["next_activity"]): r["n"] for r in out.where("idcase <> 'end'").groupBy("activity", "next_activity").agg(F.count("*").alias("n")).collect()}
    assert got == {(r["activity"], r["next_activity"]): r["n"] for r in E.directly_follows(log).collect()}
    want = {(r["id"], r["service"]) for r in E.service_duration(log).where("service is not null").collect()}
    assert {(r["id"], r["service"]) for r in out.where("idcase <> 'end'").collect()} == want
    out, _ = run(rocks, tmp_path / "repeats", [*shuffled(rows, 40), *end], lambda s: S.consecutive_repeats(s, delay="2 hours", quiet="10 days"))
    assert {r["idcase"] for r in out.collect()} == {r["idcase"] for r in E.consecutive_repeat(log).collect()}


def test_a_quiet_case_ends_and_begins_anew(rocks, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    rows = [(1, "a", at(0), None, None, "x"), (2, "b", at(1), None, None, "x"), (3, "a", at(30), None, None, "x"), (4, "c", at(31), None, None, "x")]
    end = [[(9, "z", at(100 + 100 * k), None, None, "end")] for k in range(2)]
    out, _ = run(rocks, tmp_path, [rows, *end], lambda s: S.following(s, "activity", delay="1 hour", quiet="12 hours"))
    assert {r["id"]: r["next_id"] for r in out.where("idcase = 'x'").collect()} == {1: 2, 2: None, 3: 4, 4: None}
