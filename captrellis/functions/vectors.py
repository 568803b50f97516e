"""Vector arithmetic on ``array<float|double>`` columns, one NumPy call per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Variance offset of the layer norm.
EPSILON = 1e-5


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a float64 matrix; every row must have ``width`` numbers."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (lengths != width).any():
        raise ValueError(f"vectors must be present and have {width} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def as_rows(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def per_batch(fn: Callable[[np.ndarray], np.ndarray], width: int) -> Callable[[Column | str], Column]:
    """Lift a matrix function to a column function."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(v: pa.Array) -> pa.Array:
        return as_rows(fn(as_matrix(v, width)))

    return run


def layer_norm_matrix(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPSILON)


def softmax_matrix(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def project(vec: Column | str, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """``W x (+ b)`` with ``W`` of shape (out, in)."""
    w = np.asarray(weights, dtype=np.float64)
    if w.ndim != 2 or (bias is not None and len(bias) != w.shape[0]):
        raise ValueError("weights must be (out, in) and bias (out,)")
    b = 0.0 if bias is None else np.asarray(bias, dtype=np.float64)
    return per_batch(lambda x: x @ w.T + b, w.shape[1])(vec)


def layer_norm(vec: Column | str) -> Column:
    """``(x - mean) / sqrt(var + 1e-5)`` with population variance and no affine part, in the JVM."""
    v = F.transform(vec, lambda x: x.cast("double"))
    n = F.size(vec).cast("double")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def normed(a: Column) -> Column:
        centred = F.transform(F.array(total(a) / n), lambda mean: F.transform(a, lambda x: x - mean))[0]
        return F.transform(
            F.array(centred),
            lambda c: F.transform(
                F.array(F.sqrt(total(F.transform(c, lambda x: x * x)) / n + EPSILON)),
                lambda sd: F.transform(c, lambda x: x / sd),
            )[0],
        )[0]

    return F.transform(F.array(v), normed)[0]


def softmax(vec: Column | str) -> Column:
    """Softmax over the vector, shifted by its maximum, in the JVM."""
    v = F.transform(vec, lambda x: x.cast("double"))

    def normed(a: Column) -> Column:
        e = F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda x: F.exp(x - m)))[0]
        return F.transform(
            F.array(e),
            lambda p: F.transform(
                F.array(F.aggregate(p, F.lit(0.0), lambda s, x: s + x)), lambda t: F.transform(p, lambda x: x / t)
            )[0],
        )[0]

    return F.transform(F.array(v), normed)[0]


def is_zero(vec: Column | str) -> Column:
    """Whether every number of a padding image is zero."""
    return F.forall(vec, lambda x: x == 0)


def image_seq_len(image_size: Column | int, patch: Column | int, scale: Column | int) -> Column:
    """Tokens per image: ``((image_size // patch) ** 2) / scale ** 2``, cut to an integer."""

    def c(x: Column | int) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")

    side = F.floor(c(image_size) / c(patch))
    return F.floor((side * side) / (c(scale) * c(scale)))
