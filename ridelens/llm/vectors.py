"""Vectors in Spark columns and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that has entries, none of them NULL, NaN or infinite."""
    entry_ok = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry_ok), F.lit(False))


def from_lists(column: pa.Array, dtype) -> np.ndarray:
    """Matrix of an array column whose vectors are equally long."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return entries.reshape(len(column), -1) if len(column) else entries.reshape(0, 0)


def from_binary(column: pa.Array, dtype) -> np.ndarray:
    """Matrix of a binary column that holds each vector's entries in a row."""
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(dtype).reshape(len(column), -1)


def to_binary(matrix: np.ndarray) -> pa.Array:
    """A binary column of the matrix' rows."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def to_lists(matrix: np.ndarray) -> pa.Array:
    """An array column of the matrix' rows."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))
