"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame operations only; the driver holds one row for each source.

Targets. Sources by code point, null last, weigh `weights` in turn and share `share` times all words.
No target exceeds CAP times its source's size; what is cut off is shared by weight among the others
until none is above. That is min(CAP * size, weight * level) for one level, found from running sums
over the sources in order of CAP * size / weight.

Blocks. A source's documents are dealt by a hash of doc_id to blocks of about BLOCK_WORDS words, at
most MOST_BLOCKS of them. A mix takes every block floor(target / size) times, and in one further pass
blocks in a permuted order up to the target. The block in which the target falls is taken in part: its
documents in hash order as long as they fit, then the one document nearest to the gap, if that is a gain.

Tree. Every taking of a block is an instance; a source's quota is the number of its instances. At each
node of a binary tree over the output shards the quotas are split by a multivariate-hypergeometric
draw, so that every shard gets its exact share of instances and a source's share is that of a random
deal without replacement. A source's instances, permuted, are then cut into disjoint runs by the leaf
quotas, and rows are shuffled inside their shard by a hash.

Defined results: null or empty text has 0 words; it is taken with its block, CAP times at most. A null doc_id hashes as one
value. Rows that repeat are documents of their own. Columns of the input named like those that are
added are replaced. An empty table gives an empty result. Everything is a function of rows and seed.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, words_of

CAP = 2
BLOCK_WORDS = 1 << 17
MOST_BLOCKS = 1 << 16
#: A plan of at most so many rows (about 5 MB) is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 100_000
#: From fewer instances NumPy draws by the law itself.
EXACT_DRAWS = 10**9


def hashed(*parts: Column | str) -> Column:
    """60 bits of the md5 of the parts joined by colons; null counts as a dash."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _label(source: Column) -> Column:
    """source as a key that null doesn't drop out of joins."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """sizes(src, source_size) -> src, source_size, target. One row a source."""
    n = len(weights)
    # "n" of the null source sorts before "s...", hence the first term
    rank = F.row_number().over(W.orderBy((F.col("src") == "n").cast("int"), "src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % n + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * CAP)
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))
    onward = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    all_words = F.sum("source_size").over(W.partitionBy())
    level = (F.lit(float(share)) * all_words - F.coalesce(before, F.lit(0))) / onward
    levels = ranked.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    # the first source that its level leaves below its cap: it and all later ones share that level
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(W.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.col("weight") * first["level"])
    return levels.select("src", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _drawn(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n instances, drawn without replacement, are of each source.

    The generator draws from fewer than EXACT_DRAWS instances. From more, sources are drawn one after the other by the normal law
    of the same mean and variance, cut to what the sources and the draw leave room for, so quotas stay exact.
    """
    total = int(left.sum())
    if total < EXACT_DRAWS:
        return rng.multivariate_hypergeometric(left, n, method="marginals") if total else left
    out = np.zeros_like(left)
    for i, own in enumerate(map(int, left)):
        share = own / total if total else 0.0
        spread = np.sqrt(max(0.0, n * share * (1 - share) * (total - n) / max(1, total - 1)))
        low, high = max(0, n - (total - own)), min(own, n)
        out[i] = min(high, max(low, round(n * share + spread * float(rng.standard_normal()))))
        n, total = n - int(out[i]), total - own
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """int[shards, sources]: the instances of each source that each shard gets; rows differ by one in sum at most."""
    total = int(quotas.sum())
    room = np.array([total // shards + (i < total % shards) for i in range(shards)])
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(left: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        drawn = _drawn(left, int(room[lo:mid].sum()), rng)
        split(drawn, lo, mid)
        split(left - drawn, mid, hi)

    split(quotas.astype(np.int64), 0, shards)
    return out


def planned(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """docs, all columns, with size, source_size, target and copies; and the plan of blocks.

    The plan has src, block, whole (times that all of the block is taken) and part (it is taken in part
    once more).
    """
    docs = docs.drop("size", "source_size", "target", "copies", "src", "block", "key")
    key = hashed(str(seed), F.col("doc_id"))
    rows = docs.withColumn("size", words_of(F.col("text"))).withColumn("src", _label(F.col("source"))).withColumn("key", key)
    # A first deal into fixed cells; blocks are residues of them, so that one pass over the texts serves all sums
    cell = F.col("key") % MOST_BLOCKS
    cells = checkpointed(rows.groupBy("src", cell.alias("cell")).agg(F.sum("size").alias("size")))
    sources = checkpointed(targets(cells.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share))
    number = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)))).cast("long")
    sources = sources.withColumn("blocks", number)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = cells.join(sources, "src").groupBy("src", (F.col("cell") % F.col("blocks")).alias("block"), "blocks", "source_size", "target").agg(F.sum("size").alias("words"))
    turn = W.partitionBy("src").orderBy(hashed(f"{seed}.block", F.col("src"), F.col("block")), "block")  # MOST_BLOCKS rows at most
    blocks = blocks.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    blocks = blocks.withColumn("upto", F.sum("words").over(turn.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("upto") <= F.col("rest")
    plan = blocks.withColumn("part", ~fits & (F.col("upto") - F.col("words") < F.col("rest"))).withColumn("gap", F.col("rest") - (F.col("upto") - F.col("words")))
    plan = checkpointed(plan.select("src", "block", "blocks", "source_size", "target", F.least(F.lit(CAP), F.col("whole") + fits.cast("int")).alias("whole"), "part", "gap"))
    light = plan.count() <= MOST_BROADCAST
    small = (lambda df: F.broadcast(df)) if light else (lambda df: df)
    dealt = rows.join(F.broadcast(sources.select("src", "blocks")) if light else sources.select("src", "blocks"), "src").withColumn("block", (F.col("key") % MOST_BLOCKS) % F.col("blocks")).drop("blocks")
    # documents of the blocks that are taken in part: in hash order as far as they fit, then the best of the others
    bounds = plan.where("part").select("src", "block", "gap")
    inner = dealt.join(small(bounds), ["src", "block"]).select("src", "block", "gap", "key", "doc_id", "size")
    order = W.partitionBy("src", "block").orderBy("key", "doc_id", "size")
    inner = inner.withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("turn", F.row_number().over(order))
    inner = inner.withColumn("took", F.col("upto") <= F.col("gap"))
    missing = F.col("gap") - F.coalesce(F.max(F.when(F.col("took"), F.col("upto"))).over(W.partitionBy("src", "block")), F.lit(0))
    inner = inner.withColumn("off", F.abs(F.col("size") - missing)).withColumn("missing", missing)
    better = ~F.col("took") & (F.col("off") < F.col("missing"))
    best = F.min(F.when(better, F.struct("off", "turn"))).over(W.partitionBy("src", "block"))
    picked = checkpointed(inner.withColumn("best", best["turn"]).where(F.col("took") | (F.col("turn") == F.col("best"))).groupBy("src", "block", "key", "doc_id", "size").agg(F.count("*").alias("times")))
    # rows that repeat a document can't be told apart, so the first `times` of them by number are taken
    same = W.partitionBy("src", "block", "key", "doc_id", "size").orderBy(F.lit(0))
    plan_cols = plan.select("src", "block", "source_size", "target", "whole", "part")
    out = dealt.join(small(plan_cols), ["src", "block"])
    in_part = out.where("part").withColumn("nth", F.row_number().over(same))
    there = picked.select(*[F.col(c).alias(f"__{c}") for c in ("src", "block", "key", "doc_id", "size")], "times")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("src", "block", "key", "doc_id", "size")]
    took = F.coalesce((F.col("nth") <= F.col("times")).cast("int"), F.lit(0))
    in_part = in_part.join(there, on, "left").withColumn("extra", took).select(*out.columns, "extra")
    others = out.where("not part").withColumn("extra", F.lit(0))
    named = others.unionByName(in_part).withColumn("copies", F.col("whole") + F.col("extra"))
    return named.drop("whole", "part", "extra"), plan.select("src", "block", "whole", "part")


def deal(rows: DataFrame, plan: DataFrame, shards: int = 8, seed: int = 9) -> DataFrame:
    """The takings of rows, as planned() gives both: rows, all columns, a row for each taking, with shard int and mix_key long."""
    spark = rows.sparkSession
    times = F.sequence(F.lit(1), F.col("whole") + F.col("part").cast("int"))
    instances = plan.where("whole > 0 or part").select("src", "block", F.explode(times).alias("epoch"))
    counts = {r["src"]: r["n"] for r in instances.groupBy("src").agg(F.count("*").alias("n")).collect()}
    srcs = sorted(counts)
    leaves = split_tree(np.array([counts[s] for s in srcs], dtype=np.int64), shards, np.random.default_rng(seed)) if srcs else np.zeros((shards, 0), dtype=np.int64)
    ends = leaves.cumsum(0)
    runs = [(s, i, int(ends[i, j] - leaves[i, j]), int(ends[i, j])) for j, s in enumerate(srcs) for i in range(shards) if leaves[i, j]]
    # a row for each source and shard, as a literal
    listed = F.from_json(F.lit(json.dumps([dict(zip(("src", "shard", "lo", "hi"), r, strict=True)) for r in runs])), "array<struct<src string, shard int, lo long, hi long>>")
    runs_df = spark.range(1).select(F.inline(listed))
    turn = W.partitionBy("src").orderBy(hashed(f"{seed}.deal", F.col("src"), F.col("block"), F.col("epoch")), "block", "epoch")
    numbered = instances.withColumn("place", F.row_number().over(turn) - 1)
    placed = checkpointed(numbered.join((F.broadcast(runs_df) if len(runs) <= MOST_BROADCAST else runs_df), "src").where("place >= lo and place < hi").select("src", "block", "epoch", "shard"))
    light = placed.count() <= MOST_BROADCAST
    taken = rows.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = taken.join(F.broadcast(placed) if light else placed, ["src", "block", "epoch"])
    key = hashed(f"{seed}.row", F.col("shard"), F.col("epoch"), F.col("doc_id"))
    return out.withColumn("mix_key", key).select(*rows.columns, "shard", "mix_key")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, shards: int = 8, seed: int = 9) -> DataFrame:
    """The mixed rows: docs, all columns, a row for each taking, with shard int and mix_key long.

    Rows of a shard in order of mix_key are its local shuffle.
    """
    docs = docs.drop("shard", "mix_key", "epoch")
    rows, plan = planned(docs, weights, share, seed)
    return deal(rows, plan, shards, seed).select(*docs.columns, "shard", "mix_key")
