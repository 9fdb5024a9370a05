"""Factors of a token list of any length, by blocks: the fold of MTLD without reading it in one task.

A factor begins at a place and ends at the first one where the share of different tokens has come down to the threshold; the
next begins after it. Where a factor that began at a place would end depends on the tokens after it only, so each block, with
the next one to look into, finds that for all of its places at once, and follows it inside the block: of every place it knows
where the first factor beyond the block begins and how many lie before. The few places at which blocks are entered are then
joined by doubling, log2(blocks) rounds over a small table. A factor longer than a block can see (more than 0.72 of its tokens
all different) is finished apart, by the first places of its tokens in order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MTLD_THRESHOLD
from .order import numbered, running
from .shared import kept

BLOCK = 1 << 16

_BLOCKS = "back boolean, block long, exits array<long>, weights array<double>, entries array<long>"


def placed_tokens(rows: DataFrame, *order: str) -> DataFrame:
    """back, place, token, total: the tokens of rows(toks array<string>, ...) in order, numbered from both ends."""
    counted = running(rows.withColumn("__n", F.size("toks")), "__n", *order)
    each = counted.select("total", (F.col("upto") - F.col("__n")).alias("__start"), F.posexplode("toks").alias("__i", "token"))
    place = F.col("__start") + F.col("__i")
    both = F.explode(F.array(F.struct(F.lit(False).alias("back"), place.alias("place")), F.struct(F.lit(True).alias("back"), (F.col("total") - 1 - place).alias("place"))))
    return each.select("total", "token", both.alias("__at")).select("__at.back", "__at.place", "token", "total")


def _ends(tokens: pd.Series, starts: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the first `starts` places: where a factor that begins there ends, and the different tokens it has; an end of
    len(tokens) if that isn't among these.
    """
    codes = pd.factorize(tokens)[0]
    n = len(codes)
    before = np.full(n, -1)
    by_code = np.lexsort((np.arange(n), codes))
    repeats = codes[by_code[1:]] == codes[by_code[:-1]]
    before[by_code[1:][repeats]] = by_code[:-1][repeats]
    end, types = np.full(starts, n), np.zeros(starts, dtype=np.int64)
    open_ = np.arange(starts)
    for d in range(n):
        open_ = open_[open_ + d < n]
        if not len(open_):
            break
        types[open_] += before[open_ + d] < open_
        done = types[open_] / (d + 1) <= threshold
        end[open_[done]] = open_[done] + d
        open_ = open_[~done]
    return end, types


def _block(size: int, threshold: float):
    """exits: where the first factor beyond the block begins, the total at the list's end, or -1 - place of a factor whose end
    isn't in sight; weights: the factors before that; entries: the different exits at which other blocks are entered.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        back, block = key
        rows = rows.sort_values("place")
        total, first = int(rows["total"].iloc[0]), int(block) * size
        starts = min(size, total - first)
        end, types = _ends(rows["token"], starts, threshold)
        n = len(rows)
        exits, weights = np.zeros(starts, dtype=np.int64), np.zeros(starts)
        for s in range(starts - 1, -1, -1):
            after = int(end[s]) + 1
            if after > n:
                finished = first + n == total
                exits[s] = total if finished else -1 - (first + s)
                weights[s] = (1 - types[s] / (n - s)) / (1 - threshold) if finished else 0.0
            elif after < starts:
                exits[s], weights[s] = exits[after], 1 + weights[after]
            else:
                exits[s], weights[s] = first + after, 1.0
        entries = np.unique(exits[(exits >= 0) & (exits < total)])
        return pd.DataFrame({"back": [bool(back)], "block": [int(block)], "exits": [exits], "weights": [weights], "entries": [entries]})

    return run


def _joined(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges (back, at, to, weight) followed to the end of their chain."""
    for _ in range(rounds):
        ahead = edges.select(F.col("back").alias("__back"), F.col("at").alias("__at"), F.col("to").alias("__to"), F.col("weight").alias("__weight"))
        met = edges.join(ahead, (F.col("back") == F.col("__back")) & (F.col("to") == F.col("__at")), "left")
        edges = kept(met.select("back", "at", F.coalesce("__to", "to").alias("to"), (F.col("weight") + F.coalesce("__weight", F.lit(0.0))).alias("weight")))
    return edges


def _long_end(tokens: DataFrame, at: int, total: int, threshold: float) -> tuple[int, float]:
    """Where the factor that begins at `at` ends, and 1; or the total and the part of a factor that is left there."""
    firsts = tokens.where(F.col("place") >= at).groupBy("token").agg(F.min("place").alias("first"))
    nth = kept(numbered(firsts.select("first"), "first").select("first", (F.col("i") + 1).alias("k")))
    least = F.floor(F.col("k") / F.lit(threshold))
    need = F.when(F.col("k") / least <= threshold, least).when(F.col("k") / (least + 1) <= threshold, least + 1).otherwise(least + 2)
    later = nth.select((F.col("k") - 1).alias("__k"), F.col("first").alias("__next"))
    end = F.greatest(F.col("first"), at + need - 1)
    ends = nth.join(later, F.col("k") == F.col("__k"), "left").where(end < F.coalesce("__next", F.lit(total))).agg(F.min(end).alias("end"), F.max("k").alias("k")).first()
    if ends["end"] is not None:
        return ends["end"] + 1, 1.0
    return total, (1 - nth.agg(F.max("k")).first()[0] / (total - at)) / (1 - threshold)


def factors(tokens: DataFrame, size: int = BLOCK, threshold: float = MTLD_THRESHOLD) -> tuple[int, float, float]:
    """The number of tokens, and the factors forwards and backwards, of placed_tokens(). Blocks have `size` places."""
    tokens = kept(tokens)
    total = tokens.agg(F.max("total")).first()[0]
    if not total:
        return 0, 0.0, 0.0
    own = F.floor(F.col("place") / size)
    seen = tokens.select("back", "place", "token", "total", F.explode(F.array(own, own - 1)).alias("block")).where("block >= 0")
    blocks = kept(seen.groupBy("back", "block").applyInPandas(_block(size, threshold), _BLOCKS))
    entries = blocks.select("back", F.explode("entries").alias("at")).distinct()
    of = blocks.select(F.col("back").alias("__back"), "block", "exits", "weights")
    met = entries.join(of, (F.col("back") == F.col("__back")) & (F.floor(F.col("at") / size) == F.col("block")))
    inside = (F.col("at") - F.col("block") * size).cast("int")
    edges = kept(met.select("back", "at", F.get("exits", inside).alias("to"), F.get("weights", inside).alias("weight")))
    edges = _joined(edges, math.ceil(math.log2(-(-total // size) + 1)))

    def one(back: bool) -> float:
        at, sum_ = 0, 0.0
        while at < total:
            here = blocks.where((F.col("back") == back) & (F.col("block") == at // size))
            at, weight = here.select(F.get("exits", F.lit(at % size)), F.get("weights", F.lit(at % size))).first()
            sum_ += weight
            if 0 <= at < total:
                at, weight = edges.where((F.col("back") == back) & (F.col("at") == at)).select("to", "weight").first()
                sum_ += weight
            if at < 0:
                at, weight = _long_end(tokens.where(F.col("back") == back), -1 - at, total, threshold)
                sum_ += weight
        return sum_

    return total, one(False), one(True)
