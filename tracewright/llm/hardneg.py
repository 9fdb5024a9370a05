"""Hard negatives by blocked dense products.

Method. Anchors are dealt by hash into blocks of BLOCK_BYTES at most on average; a block is broadcast and meets all candidates
twice, in products of tiles in float64 (exact: see vectors.products). First, each task keeps an anchor's best rows of its
label, in order of score; what tasks kept is merged by anchor, and the first ones are its positives. Second, with positives
and so the windows of scores known, each task keeps the best rows of other labels for every positive, merged likewise. A
task holds a tile and the best few of each anchor, so memory depends on the block, and no row of any pair is written but
these. A block's arrays pass through the driver, one block at a time.

Defined results:
- null labels, null vectors, null, NaN or infinite components: the row takes no part. A null id is never an anchor; as a
  positive or negative it comes last among ties.
- ties in score: smaller id first. Repeated rows: each is a row of its own, so an anchor's copy can be its positive, and a
  repeated anchor has its results once a copy.
- vectors of unequal length: what is missing counts as 0; an empty vector has score 0 with all.
- scores beyond a long are held at the largest long (or its negative).
- a window needs low% of the positive's score or more, and high% or less: none fits a negative score with low < high.
- empty table, or no anchor: no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import LONGEST_LONG, integers, longs, products

#: Bytes of anchors, as float64, that are broadcast at once; elements of a tile of scores.
BLOCK_BYTES, TILE = 32 << 20, 1 << 20

NONE = -LONGEST_LONG - 1  # below every score


class Best:
    """The first k entries (score, id) of each of n lists, by score downwards and then by id, null ids last."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE, dtype=np.int64)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.null = np.ones((n, k), dtype=bool)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, to: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Entries for the lists `to`."""
        last_score, last_id, last_null = (x[to, -1] for x in (self.score, self.id, self.null))
        ahead = (score > last_score) | ((score == last_score) & ((null < last_null) | ((null == last_null) & (ids < last_id))))
        to, score, ids, null = to[ahead], score[ahead], ids[ahead], null[ahead]
        if not len(to):
            return
        k = self.score.shape[1]
        lists = np.unique(to)
        to = np.concatenate([np.repeat(lists, k), to])
        score, ids, null = (np.concatenate([old[lists].ravel(), new]) for old, new in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -np.maximum(score, -LONGEST_LONG), score == NONE, to))
        to = to[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        order, to, place = order[place < k], to[place < k], place[place < k]
        self.score[to, place], self.id[to, place], self.null[to, place] = score[order], ids[order], null[order]

    def entries(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """list, score, id of all entries."""
        at, place = np.nonzero(self.score != NONE)
        return at, self.score[at, place], pa.array(self.id[at, place], mask=self.null[at, place])


@dataclass
class Anchors:
    """A block of anchors in order of label, how often each comes, and its positives: score, id, whether the id is null, and
    the bounds of the window of scores. An anchor with fewer positives has windows that nothing fits.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    times: np.ndarray
    positives: Best | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _candidates(batches: Iterable[pa.RecordBatch], scale: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """id, whether it is null, label and vector of the rows that take part, at most `most` of them at once."""
    for batch in batches:
        for at in range(0, len(batch), most):
            ids, label, vector = batch.slice(at, most).columns
            vectors, keep = integers(vector, scale)
            (ids, null), (label, no_label) = longs(ids), longs(label)
            part = ~no_label[keep]
            yield ids[keep][part], null[keep][part], label[keep][part], vectors[part]


def _positives(anchors: Anchors, batches: Iterable[pa.RecordBatch], scale: int, k: int) -> Best:
    best = Best(len(anchors.ids), k)
    for ids, null, labels, vectors in _candidates(batches, scale, 1 << 13):
        for label in np.unique(labels):
            first, end = (np.searchsorted(anchors.labels, label, side) for side in ("left", "right"))
            of = np.flatnonzero(labels == label)
            step = max(1, TILE // len(of))
            for at in range(first, end, step):
                tile = np.arange(at, min(at + step, end))
                scores = products(anchors.vectors[tile], vectors[of])
                low = best.least()[tile]
                if (low == NONE).any() and len(of) > k:
                    low = np.maximum(low, np.partition(scores, -k, axis=1)[:, -k])
                row, column = np.nonzero(scores >= low[:, None])
                best.add(tile[row], scores[row, column], ids[of[column]], null[of[column]])
    return best


def _negatives(anchors: Anchors, batches: Iterable[pa.RecordBatch], scale: int, k: int) -> Best:
    """Lists are numbered anchor * positives + positive."""
    n, each = anchors.low.shape
    best = Best(n * each, k)
    for ids, null, labels, vectors in _candidates(batches, scale, 1 << 12):
        step = max(1, TILE // max(1, len(ids)))
        for at in range(0, n, step):
            tile = slice(at, at + step)
            scores = products(anchors.vectors[tile], vectors)
            scores[anchors.labels[tile, None] == labels[None, :]] = NONE
            low = np.maximum(anchors.low[tile], best.least().reshape(n, each)[tile])
            high = anchors.high[tile]
            row, column = np.nonzero((scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None]))
            score = scores[row, column]
            for j in range(each):
                fits = (score >= low[row, j]) & (score <= high[row, j])
                best.add((at + row[fits]) * each + j, score[fits], ids[column[fits]], null[column[fits]])
    return best


def _block(anchors: DataFrame, block: int) -> Anchors:
    """The anchors of a block: the one thing of its size on the driver."""
    rows = anchors.where(F.col("block") == block).collect()
    rows.sort(key=lambda r: (r["label"], r["id"], r["vector"]))
    width = max(len(r["vector"]) for r in rows)
    vectors = np.array([r["vector"] + [0.0] * (width - len(r["vector"])) for r in rows]).reshape(len(rows), width)
    ids, labels, times = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("id", "label", "times"))
    return Anchors(ids, labels, vectors, times)


def _with_positives(anchors: Anchors, found: list, k: int, low: int, high: int) -> Anchors:
    """found: the best k + 1 rows (anchor, score, id) of its label for each anchor, itself among them if it is that good."""
    lists = defaultdict(list)
    for r in found:
        lists[r["anchor"]].append((-r["score"], r["id"] is None, r["id"] or 0))
    n = len(anchors.ids)
    best = Best(n, k)
    lows, highs = np.full((n, k), LONGEST_LONG, dtype=np.int64), np.full((n, k), NONE, dtype=np.int64)
    for a, entries in lists.items():
        entries.sort()
        own = (-int(products(anchors.vectors[a : a + 1], anchors.vectors[a : a + 1])[0, 0]), False, int(anchors.ids[a]))
        if own in entries:
            entries.remove(own)
        for j, (score, null, found_id) in enumerate(entries[:k]):
            best.score[a, j], best.null[a, j], best.id[a, j] = -score, null, found_id
            lows[a, j] = min(LONGEST_LONG, max(-LONGEST_LONG, -((low * score) // 100)))
            highs[a, j] = min(LONGEST_LONG, max(-LONGEST_LONG, high * -score // 100))
    return Anchors(anchors.ids, anchors.labels, anchors.vectors, anchors.times, best, lows, highs)


def _first(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The first k rows of each key, numbered by `rank`; planned with a limit of k before the shuffle too."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchor: Column,
    scratch: Scratch,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(id long, label long, vector array).

    Anchors are the rows for which `anchor` holds. Components are taken as floor(scale * x). The result reads tables of `scratch`.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "label", "vector")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, labels, vectors in _candidates(batches, scale, 1 << 13):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(list(vectors), pa.list_(pa.float64()))], names=["id", "label", "vector"])

    anchors = rows.where(anchor & F.col("id").isNotNull()).mapInArrow(whole, "id long, label long, vector array<double>")
    anchors = scratch.keep(anchors.groupBy("id", "label", "vector").agg(F.count("*").alias("times")), "anchors")
    n, width, most = anchors.agg(F.count("*"), F.max(F.size("vector")), F.max("times")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], result)
    blocks = -(-n * max(1, width) * 8 // block_bytes)
    numbered = anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)))
    anchors = scratch.keep(numbered.repartitionByRange("block").sortWithinPartitions("block"), "blocks")
    paths = []
    for block in (r["block"] for r in anchors.select("block").distinct().orderBy("block").toLocalIterator()):
        held = _block(anchors, block)
        found = _first(rows.mapInArrow(_first_pass(spark, held, scale, positives + 1), "anchor long, score long, id long"), "anchor", positives + 1)
        held = _with_positives(held, found.collect(), positives, low, high)
        mined = rows.mapInArrow(_second_pass(spark, held, scale, negatives), "list long, anchor_id long, positive_id long, positive_score long, times long, score long, id long")
        mined = _first(mined, "list", negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        scratch.keep(mined.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score", "times"), "mined")
        paths.append(scratch.paths[-1])
    out = spark.read.schema(f"{result}, times long").parquet(*paths)
    if most > 1:
        out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(times - 1) div 4096")))).hint("rebalance")
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096), F.expr("times - part * 4096")))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _first_pass(spark, held: Anchors, scale: int, k: int):
    shipped = spark.sparkContext.broadcast(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, score, ids = _positives(shipped.value, batches, scale, k).entries()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score), ids], names=["anchor", "score", "id"])

    return run


def _second_pass(spark, held: Anchors, scale: int, k: int):
    shipped = spark.sparkContext.broadcast(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        at, score, ids = _negatives(held, batches, scale, k).entries()
        anchor, j = np.divmod(at, held.low.shape[1])
        of = held.positives
        positive = pa.array(of.id[anchor, j], mask=of.null[anchor, j])
        columns = [pa.array(x) for x in (at, held.ids[anchor])] + [positive] + [pa.array(x) for x in (of.score[anchor, j], held.times[anchor], score)] + [ids]
        yield pa.RecordBatch.from_arrays(columns, names=["list", "anchor_id", "positive_id", "positive_score", "times", "score", "id"])

    return run
