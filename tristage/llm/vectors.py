"""Vectors as exact integers, in blocks of packed rows, for the operators on embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = 1 << 63
#: Up to here doubles hold every integer.
EXACT = 1 << 53
_KINDS = [np.int8, np.int16, np.int32, np.int64]


def whole(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def integers(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x), as 64-bit integers if all are far below 2^63, else as Python's."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() * factor < EXACT:
        return np.floor(x * factor).astype(np.int64)
    # a double of 2^52 or more is an integer
    exact = [int(v) * factor if abs(v) >= 1 << 52 else math.floor(v * factor) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def matrix(column: pa.ListArray, dim: int, factor: int) -> np.ndarray:
    """The integers of a column of vectors that all have dim finite components."""
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), factor)


def peak(m: np.ndarray) -> int:
    """The largest magnitude."""
    return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0


def fit(m: np.ndarray, bound: int) -> np.ndarray:
    """m in 64-bit integers if bound, which nothing reckoned from it exceeds, is below 2^63, else in Python's."""
    return m.astype(np.int64 if bound < LONG else object)


def pack(m: np.ndarray) -> bytes:
    """The integers in the narrowest type that holds them; the first byte tells which."""
    top = peak(m)
    for i, kind in enumerate(_KINDS):
        if top <= np.iinfo(kind).max:
            return bytes([i]) + np.ascontiguousarray(m.astype(kind)).tobytes()
    return bytes([len(_KINDS)]) + ",".join(map(str, m.ravel().tolist())).encode()


def unpack(data: bytes, columns: int) -> np.ndarray:
    if data[0] < len(_KINDS):
        return np.frombuffer(data, _KINDS[data[0]], offset=1).reshape(-1, columns).astype(np.int64)
    return np.array(list(map(int, data[1:].split(b","))), object).reshape(-1, columns)


def sums_by(at: np.ndarray, m: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of rows by their group's number, as Python's integers."""
    out = np.zeros((groups, m.shape[1]), object)
    if len(m):
        m = fit(m, peak(m) * len(m))
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        out[held] = np.add.reduceat(m[order], first, axis=0)
    return out


def means(old: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """floor(sum / count) by row; rows without members stay."""
    new = np.array([[s // n for s in row] if n else was for was, row, n in zip(old.tolist(), sums.tolist(), counts.tolist(), strict=True)], object)
    return new.reshape(old.shape)


def longs(values) -> pa.Array:
    """As a column of longs; null for what a long can't hold."""
    return pa.array([v if -LONG <= v < LONG else None for v in map(int, values)], pa.int64())
