"""Columns of arrays of one length as matrices, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays, all of one length, as a matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, width)), *(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in parts)])


def array(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
