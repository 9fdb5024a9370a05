"""Filters by bounded bitmaps: what surely isn't wanted is dropped before a shuffle.

A bitmap has 2**BITS bits (4 MB) at any size of the input, so it can be broadcast. It lets all wanted
values through and some others; whoever filters by it must not depend on those being gone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25
_U = np.uint64


def places(values: np.ndarray) -> np.ndarray:
    x = values.view(np.uint64) * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - BITS)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a long column, words of 64 bits, put together on the executors. Nulls have no bit."""

    def run(batches):
        for b in batches:
            at = np.unique(places(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)))
            if len(at):
                word = at >> _U(6)
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                bits = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word[starts].astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = df.select(column).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = places(values)
    return (bits[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)


def sifted(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows of df whose long column passes; null doesn't."""
    known = df.sparkSession.sparkContext.broadcast(bits)
    at = df.schema.names.index(column)

    def run(batches):
        for b in batches:
            values = b.column(at)
            mask = passes(known.value, values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & np.asarray(values.is_valid())
            yield b.filter(pa.array(mask))

    return df.mapInArrow(run, df.schema)
