"""Vectors from Arrow: which rows hold a usable one, and these as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows whose vector isn't null, zero, or with null or non-finite components, and these vectors as
    doubles. A vector shorter than dims is filled with zeros."""
    n = len(column)
    out = np.zeros((n, dims))
    flat = column.flatten()  # without what null rows may hold
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(column.offsets.to_numpy()))
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), length)
    at = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
    out[row, at] = values
    out += 0.0
    size = np.abs(out).max(1, initial=0)  # of squares, large or tiny ones would over- or underflow
    rows = np.flatnonzero(np.isfinite(size) & (size > 0))
    return rows, out[rows]


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x at length 1, whatever their magnitude."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1))[:, None]
