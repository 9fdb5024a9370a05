"""Integer vectors out of Arrow batches, and products of them that are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
LONGEST_LONG = (1 << 63) - 1


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, as whole numbers in float64, of the rows to keep; and which rows these are.

    Null vectors and those with null, NaN or infinite components are left out. Shorter vectors are filled with 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    keep = column.is_valid().to_numpy(zero_copy_only=False).copy()
    row = np.repeat(np.arange(len(column)), lengths)
    keep[row[~np.isfinite(values)]] = False
    width = int(lengths.max(initial=0))
    if len(column) and (lengths == width).all():
        matrix = values.reshape(len(column), width)[keep]
    else:
        full = np.zeros((len(column), width))
        full[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        matrix = full[keep]
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(matrix * scale, -most, most)), keep


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as int64, 0 for null, and which are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), null


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact, as int64; those beyond a long are held at the nearest but one.

    Rows whose components are small enough for every sum to stay below 2**53 are multiplied in float64; only the others go
    by whole numbers of any size.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = np.sqrt(EXACT / max(width, 1)) - 1
    low_a, low_b = (np.abs(x).max(axis=1, initial=0) <= most for x in (a, b))
    if low_a.all() and low_b.all():
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    out[np.ix_(low_a, low_b)] = a[low_a] @ b[low_b].T
    for rows, columns in ((~low_a, np.ones(len(b), bool)), (low_a, ~low_b)):
        if rows.any() and columns.any():
            whole = _whole(a[rows]) @ _whole(b[columns]).T
            out[np.ix_(rows, columns)] = np.clip(whole, -LONGEST_LONG, LONGEST_LONG).astype(np.int64)
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
