"""Vectors as exact integers, for the operators that cluster and code them."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Components beyond this have squared distances that 64 bits do not hold; they raise.
LARGEST = 1 << 26


def usable(vector: str) -> Column:
    """True for a vector that is not null and holds neither null nor non-finite components."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """array<int> of floor(scale * x), x as double."""
    def one(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, y).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).cast("int")
    return F.transform(F.col(vector), one)


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows of int64."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(data)])


def flat(values: pa.Array, dtype) -> np.ndarray:
    """The numbers of binary values one after the other."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[at[0]:at[-1]].view(dtype)


def unpacked(values: pa.Array, dtype) -> np.ndarray:
    return flat(values, dtype).reshape(len(values), -1)


def sums_by(groups: np.ndarray, n_groups: int, rows: np.ndarray) -> np.ndarray:
    """Exact sums of the rows of each group."""
    out = np.zeros((n_groups, rows.shape[1]), np.int64)
    np.add.at(out, groups, rows)
    return out
