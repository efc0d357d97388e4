"""Arrow columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors without null or non-finite entries, and these vectors as doubles.

    Shorter vectors are followed by zeros up to `width` (default: the longest of the column).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    missing = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(flat)
    if missing is not None:
        bad |= missing
    ends = np.cumsum(lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    if bad.any():
        good[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = False
    places = np.flatnonzero(good)
    if width is None:
        width = int(lengths[places].max(initial=0))
    if width and (lengths == width).all():
        return places, flat.reshape(-1, width)[places]
    out = np.zeros((len(places), width))
    own = lengths[places]
    row = np.repeat(np.arange(len(places)), own)
    column_of = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    out[row, column_of] = flat[np.repeat(ends[places] - own, own) + column_of]
    return places, out


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))
