"""Distributed union-find: connected components of an edge table by randomised contraction.

Each round gives every node the neighbour (or itself) of least hash under a fresh seed as its
representative, maps both ends of all edges to representatives and drops loops, which removes at
least a constant share of the nodes in expectation; so rounds are logarithmic even on long chains.
(Bögeholz, Brand and Todor, "In-database connected component analysis", ICDE 2020.) Once LAST edges
or fewer are left, a count that is checked, one task finishes them by union-find. The maps of the
rounds shrink geometrically and are composed from the last to the first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LAST = 10_000


def _united(parts):
    """Union-find over all pairs (a, b) of one bounded partition: u, r with r the root of u."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for part in parts:
        for a, b in zip(part["a"], part["b"], strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"u": list(parent), "r": [root(x) for x in parent]})


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """edges(a, b), both long -> (node, component), component the least node of each component.

    Only nodes with an edge occur. Null ends and loops are dropped; repeated and reversed edges are
    harmless; an empty table gives an empty result. The result is a table of `keep`.
    """
    own = Scratch(keep.spark)
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = own.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while edges.count() > LAST:
        seed = F.lit(7919 * len(rounds) + 17)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        picked = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v", seed)).alias("v"))
        nearer = F.xxhash64("v", seed) < F.xxhash64("u", seed)
        picked = own.keep(picked.select("u", F.when(nearer, F.col("v")).otherwise(F.col("u")).alias("r")), "picked")
        rounds.append(picked)
        left = picked.select(F.col("u").alias("a"), F.col("r").alias("ra"))
        right = picked.select(F.col("u").alias("b"), F.col("r").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = own.keep(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    labels = edges.coalesce(1).mapInPandas(_united, "u long, r long")
    for picked in reversed(rounds):
        later = labels.select(F.col("u").alias("r"), F.col("r").alias("s"))
        labels = picked.join(later, "r", "left").select("u", F.coalesce("s", "r").alias("r"))
    least = labels.groupBy("r").agg(F.min("u").alias("component"))
    out = keep.keep(labels.join(least, "r").select(F.col("u").alias("node"), "component"), "components")
    own.clear()
    return out
