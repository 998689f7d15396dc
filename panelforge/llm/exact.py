"""Exact sums of integers in tasks and over them; imported by tasks, so free of Spark.

An integer of any size is handed on as digits to the base 2 ** 32, of which the highest has the sign;
sums of digits are longs, so Spark can add what tasks hand on, however large the integers are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGIT = 32
#: Integers below this keep to longs in what follows: their sums and differences of two don't overflow.
LONG = 1 << 61


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a column of lists as doubles, one list after the other, where each starts, and which lists are whole.

    A whole list is neither null nor has an entry that is null or not finite.
    """
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)  # a null list has none
    starts = np.concatenate([[0], np.cumsum(size)])
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is not a number
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = (bad[starts[1:]] == bad[starts[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return values, starts, whole


def floors(values: np.ndarray, scale: int, plus: int = 0) -> np.ndarray:
    """floor(scale * value) + plus; Python's integers where longs are too short."""
    scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() + abs(plus) < LONG:
        return scaled.astype(np.int64) + plus
    return np.array([int(v) + plus for v in scaled.ravel()], dtype=object).reshape(scaled.shape)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Digits of integers, the lowest first, as longs."""
    count = max(1, -(-(largest(x).bit_length() + 1) // DIGIT))
    out = [(x >> (DIGIT * k)) & ((1 << DIGIT) - 1) for k in range(count - 1)]
    return [d.astype(np.int64) for d in [*out, x >> (DIGIT * (count - 1))]]


def from_digits(rows) -> dict:
    """key -> integer, of (key, digit, sum) in any order."""
    out: dict = {}
    for key, digit, value in rows:
        out[key] = out.get(key, 0) + (int(value) << (DIGIT * digit))
    return out
