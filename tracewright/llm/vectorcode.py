"""Codes of vectors by integer codebooks, one for each part of a vector.

Method. Components become whole numbers and vectors are cut into equal parts. The codebooks are broadcast (parts x entries
x width longs: 256 KB for 64 components, and they don't grow with the rows). Arrow batches take all distances of a block of
parts by the norm expansion |x|^2 - 2xc + |c|^2 from an int64 matrix product, and the first least one. A round sums what each
entry got: within a task, then in a shuffle grouped by entry; the driver holds one row for each entry. The last assignment is
stored, and its errors are summed by label and joined back, so a label of a third of all rows stays spread.

Defined results:
- null vectors, null, NaN or infinite components: the row is dropped. A null id comes last in the order of ids; null labels
  are one label.
- ties in distance: the entry of lower index. Repeated ids: each row counts, in order of their vectors.
- fewer rows than entries: as many entries as rows. Entries that no part chose stay as they are.
- vectors of unequal length, or of one that the parts don't divide: what is missing counts as 0.
- components beyond +-sqrt(2**58 / width of a part) (131,072 x 1,024 for 64 components in 4 parts) are held at that, so that
  distances and their sum fit a long; a label's sum beyond a long is held at the largest.
- empty table: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import LONGEST_LONG, integers

#: Rows whose distances to a codebook are held at once.
ROWS = 4096


class Codebooks:
    """entries: parts x entries x width of a part, int64."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries)
        self.turned = np.ascontiguousarray(entries.transpose(0, 2, 1))
        self.norms = (entries * entries).sum(axis=2)

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part of each row, and its squared distances summed over the parts."""
        parts, _, width = self.entries.shape
        codes = np.empty((len(vectors), parts), dtype=np.int64)
        error = (vectors * vectors).sum(axis=1)
        every = np.arange(len(vectors))
        for p in range(parts):
            distance = vectors[:, p * width : (p + 1) * width] @ self.turned[p]
            distance *= -2
            distance += self.norms[p]
            codes[:, p] = distance.argmin(axis=1)
            error += distance[every, codes[:, p]]
        return codes, error


def most(width: int) -> int:
    """The largest component kept, for parts of this width."""
    return math.isqrt((1 << 58) // max(1, width))


def whole(column: pa.Array, scale: int, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of parts * width whole numbers, and which rows of the column they are."""
    found, keep = integers(column, scale)
    out = np.zeros((len(found), parts * width), dtype=np.int64)
    out[:, : found.shape[1]] = np.clip(found, -most(width), most(width))
    return out, keep


def kept(rows: DataFrame) -> DataFrame:
    """Rows whose vector is whole: neither null nor with null, NaN or infinite components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS))


def first_codebooks(rows: DataFrame, scale: int, parts: int, entries: int) -> Codebooks | None:
    """The parts of the rows of least ids; None without any row."""
    whole_rows = kept(rows)
    longest = whole_rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    first = whole_rows.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    vectors, _ = whole(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, parts, width)
    return Codebooks(vectors.reshape(len(first), parts, width).transpose(1, 0, 2))


def improved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """The codebooks after one round: each entry the floor of the mean of the parts that chose it."""
    parts, entries, width = books.entries.shape
    shipped = rows.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for block in _blocks(batches):
            vectors, _ = whole(block.column(0), scale, parts, width)
            codes, _ = books.nearest(vectors)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        values = pa.array(sums[part, entry].ravel())
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), listed], names=["part", "entry", "n", "sums"])

    sums = rows.select("vector").mapInArrow(summed, "part int, entry int, n long, sums array<long>")
    columns = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns)
    out = books.entries.copy()
    for r in merged.collect():
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(out)


def coded(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """id, label, code string, error long: the rows under these codebooks."""
    parts, _, width = books.entries.shape
    shipped = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            vectors, keep = whole(block.column(2), scale, parts, width)
            codes, error = shipped.value.nearest(vectors)
            digits = codes.astype(np.uint8).tobytes().hex()
            code = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            ids, label = (block.column(c).filter(pa.array(keep)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(code, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "vector").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(rows: DataFrame, scratch: Scratch, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """id, label, code, error, label_error long, codebooks_sha256 of rows(id, label, vector); two hex digits for each part.

    The result reads a table of `scratch`.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits a part: from 1 to 256 entries")
    books = first_codebooks(rows, scale, parts, entries)
    if books is None:
        kinds = dict(rows.dtypes)
        return rows.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        books = improved(rows, books, scale)
    found = scratch.keep(coded(rows, books, scale), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST_LONG).cast("decimal(38,0)")).cast("long")
    by_label = found.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return found.join(by_label, found["label"].eqNullSafe(by_label["of"])).select("id", "label", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
