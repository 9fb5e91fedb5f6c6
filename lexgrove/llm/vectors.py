"""What the operators on integer vectors share: components as integers, exact products and distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components are held within this bound on both sides, results within that of a long.
MOST, LONG = 1 << 62, (1 << 63) - 1


def finite(v: Column) -> Column:
    """True for a vector that is neither null nor holds null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double, within MOST."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x.astype(np.float64))
    out = np.clip(y, -float(MOST), float(MOST - 1024)).astype(np.int64)
    out[y >= MOST] = MOST
    return out


def largest(v: np.ndarray) -> int:
    return max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and of b: doubles where no sum can leave their 53 bits, else long or, beyond 62 bits, Python integers."""
    bound = a.shape[1] * largest(a) * largest(b)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if bound < 1 << 62 else a.astype(object) @ b.astype(object).T


def square(v: np.ndarray) -> np.ndarray:
    """Exact squared length of each row."""
    bound = v.shape[1] * largest(v) ** 2
    w = v if bound < 1 << 62 else v.astype(object)
    return (w * w).sum(axis=1)


def as_long(x: np.ndarray) -> np.ndarray:
    """Exact numbers as longs; those beyond 64 bits as the nearest long, its least one aside."""
    return x if x.dtype != object else np.clip(x, -LONG, LONG).astype(np.int64)


def stacked(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id (as it is) and v of the vectors that are null nowhere and finite."""
    v = F.col(f"`{vector}`")
    return vectors.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where(finite(F.col("v")))
