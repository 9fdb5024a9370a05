"""Sharding by sampled splitters.

Records are ordered by a key, 60 bits of the md5 of the text and then doc_id, so that equal texts are
neighbours. Key samples are drawn with probability proportional to size, their weighted quantiles
become splitters, and records are range-partitioned between them. Ranges that come out overfull, such
as one that holds a hot text, are subdivided by splitters from a denser sample of their own, until
each is bounded, its largest record apart. Exact sums per range then give every record its exact place in
the whole order, from which its shard and its slot follow:

- law `bytes`: the shard in which the middle of the record's bytes falls when the whole is cut into
  equal parts; a shard is off by half a record at each end at most.
- law `rows`: the shard in which its row number falls; counts differ by one at most.

Defined results: null text counts as empty; a record's size is its UTF-8 bytes plus 1, so it is never
0. A null doc_id sorts first. Rows that repeat are records of their own. Columns of the input named
like those that are added are replaced, as are __h, __d and __r. A long text stays whole in one shard; ties in key go
by doc_id, and rows of equal text and doc_id come in any order. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Ranges: RANGES_A_SHARD a shard, or of about RANGE_BYTES, but MOST_RANGES at most (before subdivision).
RANGES_A_SHARD, RANGE_BYTES, MOST_RANGES = 16, 64 << 20, 1 << 16
#: Samples for each range, in expectation.
DRAWS = 24
OVERFULL = 2.0
_LOW = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return docs.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("__h", h).withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)))


def _splitters(samples: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Keys that cut the samples (key, key, weight) into `ranges` parts of equal weight."""
    samples = sorted(samples)
    weight = np.cumsum([w for _, _, w in samples])
    if not len(weight):
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return sorted({samples[min(i, len(samples) - 1)][:2] for i in at})


def _range_of(splitters: list[tuple[int, int]]):
    """A pandas UDF: the number of splitters that are not above the key (h, d)."""
    high = np.array([h for h, _ in splitters], dtype=np.int64)
    low = np.array([d for _, d in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def number(h: pd.Series, d: pd.Series) -> pd.Series:
        keys = h.to_numpy()
        first, last = np.searchsorted(high, keys, "left"), np.searchsorted(high, keys, "right")
        for i in np.flatnonzero(first < last):
            first[i] += np.searchsorted(low[first[i] : last[i]], d.iloc[i], "right")
        return pd.Series(first.astype(np.int32))

    return number


def shard(docs: DataFrame, shards: int = 8, law: str = "bytes") -> DataFrame:
    """docs, all columns, with size long, law string, shard int, slot long (gapless from 0 in a shard)."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    spark = docs.sparkSession
    docs = docs.drop("size", "law", "shard", "slot", "__h", "__d", "__r")
    names = docs.columns
    keep = Scratch(spark)
    keys = keep.keep(_keyed(docs.select("doc_id", "text")).select("__h", "__d", "size"), "keys")
    weight = F.lit(1) if law == "rows" else F.col("size")
    total, n = keys.agg(F.sum(weight), F.count("*")).first()
    total = total or 0
    ranges = min(MOST_RANGES, max(RANGES_A_SHARD * shards, -(-total // RANGE_BYTES)))
    aim = max(1.0, total / ranges)
    turn = 0

    def drawn(rows: DataFrame, rate: float) -> list[tuple[int, int, float]]:
        u = F.pmod(F.xxhash64("__h", "__d", F.lit(8 + turn)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        found = rows.where(u < weight * F.lit(rate)).select("__h", "__d", weight.alias("w")).toLocalIterator()
        return [(r["__h"], r["__d"], max(1.0, r["w"] * rate)) for r in found]

    splitters = _splitters(drawn(keys, DRAWS / aim), ranges)
    while True:
        numbered = keys.withColumn("__r", _range_of(splitters)("__h", "__d"))
        sums = numbered.groupBy("__r").agg(F.sum("size").alias("bytes"), F.sum(weight).alias("w"), F.max(weight).alias("big"), F.count("*").alias("n"), F.min(F.struct("__h", "__d")).alias("lo"), F.max(F.struct("__h", "__d")).alias("hi"))
        sums = sorted(sums.collect(), key=lambda r: r["__r"])
        # a record that is larger than a range can't be divided; what stands beside it can
        over = [r["__r"] for r in sums if r["w"] - r["big"] > OVERFULL * aim and r["lo"] != r["hi"]]
        if not over:
            break
        turn += 1
        parts = spark.createDataFrame([(r,) for r in over], "__r int")
        dense = drawn(numbered.join(F.broadcast(parts), "__r"), 4 * DRAWS / aim)
        by: dict[int, list] = {r: [] for r in over}
        for h, d, w in dense:
            by[bisect_right(splitters, (h, d))].append((h, d, w))
        more = {s for r in sums if r["__r"] in by for s in [*_splitters(by[r["__r"]], int(r["w"] // aim) + 1), (r["hi"]["__h"], r["hi"]["__d"])]}
        splitters = sorted({*splitters, *more})
    bytes_before = np.cumsum([0, *[r["bytes"] for r in sums]]).tolist()
    rows_before = np.cumsum([0, *[r["n"] for r in sums]]).tolist()
    bases = spark.createDataFrame([(r["__r"], b, i) for r, b, i in zip(sums, bytes_before, rows_before, strict=False)], "__r int, __b long, __i long")
    order = W.partitionBy("__r").orderBy("__h", "__d", "size")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__r", _range_of(splitters)("__h", "__d"))
        rows = rows.withColumn("__run", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(order))
        rows = rows.join(F.broadcast(bases), "__r").withColumn("__row", F.col("__i") + F.col("__n") - 1)
        if law == "rows":
            at = F.expr(f"__row * {shards} div {max(1, n)}")
        else:
            # twice the middle of the record's bytes, in whole numbers
            at = F.expr(f"least({shards} - 1, (2 * (__b + __run) - size) * {shards} div {2 * max(1, bytes_before[-1])})")
        return rows.withColumn("shard", at.cast("int"))

    firsts = placed(keys).groupBy("shard").agg(F.min("__row").alias("__first")).collect()
    first = spark.createDataFrame([(r["shard"], r["__first"]) for r in firsts], "shard int, __first long")
    out = placed(_keyed(docs)).join(F.broadcast(first), "shard").withColumn("slot", F.col("__row") - F.col("__first")).withColumn("law", F.lit(law))
    out = out.select(*names, "size", "law", "shard", "slot")
    keep.clear()
    return out
