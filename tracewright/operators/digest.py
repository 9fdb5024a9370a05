"""Digests of whole results, so that two results are compared without keeping, joining or collecting their rows.

A row's cells are hashed to 128 bits under a key. Each partition folds its rows, in the order in which they come, into one
row: how many they are, the sum of their hashes (equal multisets have equal sums) and their polynomial in a base of the key
(equal lists have equal values). Partitions are joined by p(a + b) = p(a) * base^len(b) + p(b), so neither depends on how rows
are cut into partitions. Two different results meet in a digest with a probability of about rows / 2^126.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 127) - 1
WIDE = 1 << 128


@dataclass(frozen=True)
class Key:
    """What hashes of one comparison share; drawn anew for each, no result can be made to meet another."""

    low: int
    high: int
    base: int

    @staticmethod
    def drawn() -> Key:
        return Key(secrets.randbits(62), secrets.randbits(62), secrets.randbelow(PRIME - 3) + 2)


@dataclass(frozen=True)
class Digest:
    """rows, the multiset's sum, the list's polynomial, and the first rows."""

    count: int = 0
    bag: int = 0
    sequence: int = 0
    head: tuple[tuple[str, ...], ...] = ()

    def then(self, later: Digest, key: Key, head: int) -> Digest:
        """The digest of these rows followed by those of `later`."""
        sequence = (self.sequence * pow(key.base, later.count, PRIME) + later.sequence) % PRIME
        return Digest(self.count + later.count, (self.bag + later.bag) % WIDE, sequence, (self.head + later.head)[:head])

    def same(self, other: Digest, ordered: bool) -> bool:
        mine, others = (self.sequence, other.sequence) if ordered else (self.bag, other.bag)
        return self.count == other.count and mine == others


def digest(rows: DataFrame, key: Key, head: int = 0) -> Digest:
    """The digest of rows(row array<string>) in their order, with the first `head` rows; the driver gets a row for each partition."""
    hashed = rows.select(F.xxhash64(F.lit(key.low), "row").alias("low"), F.xxhash64(F.lit(key.high), "row").alias("high"), "row")
    if not head:
        hashed = hashed.drop("row")
    base = key.base

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, bag, sequence, first = 0, 0, 0, []
        for batch in batches:
            if len(first) < head:
                first += batch.column(2).slice(0, head - len(first)).to_pylist()
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = ((high & 0xFFFFFFFFFFFFFFFF) << 64) | (low & 0xFFFFFFFFFFFFFFFF)
                bag += h
                sequence = (sequence * base + h + 1) % PRIME
            count += len(batch)
        part = TaskContext.get().partitionId()
        arrays = [[part], [count], [str(bag % WIDE)], [str(sequence)], pa.array([first], pa.list_(pa.list_(pa.string())))]
        yield pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, list) else a for a in arrays], names=["part", "count", "bag", "sequence", "head"])

    parts = hashed.mapInArrow(folded, "part long, count long, bag string, sequence string, head array<array<string>>").collect()
    parts.sort(key=lambda r: r["part"])
    digests = (Digest(r["count"], int(r["bag"]), int(r["sequence"]), tuple(map(tuple, r["head"] or ()))) for r in parts)
    return reduce(lambda a, b: a.then(b, key, head), digests, Digest())
