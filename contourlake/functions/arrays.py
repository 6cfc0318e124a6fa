"""Array-column helpers: literals, local bindings, order statistics and linear maps.

A frame of a time-frequency grid is one ``ARRAY<DOUBLE>`` and a call is an array of frames, so most
per-frame mathematics is a narrow projection.  ``let`` evaluates its argument once: a column used
inside a lambda body would otherwise be recomputed for every element after projections collapse.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO = "0.0D"


def num(x: float) -> str:
    """SQL text of a double literal."""
    return f"{float(x)!r}D"


def constant(value: object, ddl: str) -> Column:
    """Constant of a nested type as one JSON literal.

    The analyzer sees two nodes instead of one per element, and constant folding turns it into one literal.
    """
    return F.from_json(F.lit(json.dumps(value)), ddl)


def dlit(values: Sequence[float]) -> Column:
    """Constant ``ARRAY<DOUBLE>``."""
    return constant([float(v) for v in values], "array<double>")


def ilit(values: Sequence[int]) -> Column:
    return constant([int(v) for v in values], "array<int>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def seq(n: Column | int) -> Column:
    """``[0, n)``; empty when n is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return let(a, lambda v: F.when(F.size(v) > 0, array_sum(v) / F.size(v)))


def percentile(a: Column, p: float) -> Column:
    """Linear-interpolated percentile of an array (null when empty)."""

    def body(s: Column) -> Column:
        pos = (F.size(s) - 1) * F.lit(float(p))
        lo = F.floor(pos).cast("int")
        left = F.get(s, lo)
        right = F.get(s, F.least(lo + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, left + (right - left) * (pos - lo))

    return let(F.array_sort(a), body)


def median(a: Column) -> Column:
    return percentile(a, 0.5)


def first_max(a: Column) -> Column:
    """Index of the maximum, lowest index on ties."""
    ranked = F.transform(a, lambda x, i: F.struct(x.alias("v"), (-i).alias("ni")))
    return -F.array_max(ranked)["ni"]


def first_min(a: Column) -> Column:
    ranked = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return F.array_min(ranked)["i"]


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def _rows_literal(matrix: np.ndarray) -> Column:
    """Sparse rows of a constant matrix: array of (i, w)."""
    rows = []
    for row in np.asarray(matrix, dtype=float):
        nz = np.flatnonzero(row)
        rows.append({"i": [int(i) for i in nz], "w": [float(row[i]) for i in nz]})
    return constant(rows, "array<struct<i:array<int>,w:array<double>>>")


def linear_map(frames: Column, matrix: np.ndarray, strategy: str = "expr") -> Column:
    """Apply a constant matrix to every frame of an ``ARRAY<ARRAY<DOUBLE>>`` column.

    The matrix comes from configuration (channels x candidates), never from data.  ``expr`` keeps the work in the
    JVM as sparse dot products, for any size of matrix; ``arrow`` multiplies a call's frames with numpy and suits a
    single step (a Python function cannot stand inside other array expressions).
    """
    matrix = np.asarray(matrix, dtype=float)
    if strategy == "expr":
        if np.count_nonzero(matrix) > 0.5 * matrix.size:
            full = constant([[float(x) for x in row] for row in matrix], "array<array<double>>")
            dot = lambda v, r: F.zip_with(r, v, lambda w, x: w * x)
        else:
            full = _rows_literal(matrix)
            dot = lambda v, r: F.zip_with(r["i"], r["w"], lambda i, w: w * F.get(v, i))
        return F.transform(
            frames,
            lambda v: F.transform(full, lambda r: F.aggregate(dot(v, r), F.lit(0.0), lambda s, x: s + x)),
        )
    if strategy != "arrow":
        raise ValueError("unknown strategy, use 'arrow' or 'expr'")
    transposed = np.ascontiguousarray(matrix.T)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def multiply(col: pd.Series) -> pd.Series:
        return col.map(lambda fr: list(np.stack(list(fr)) @ transposed) if fr is not None and len(fr) else [])

    return multiply(frames)


def linear_map_frame(frame: Column, matrix: np.ndarray) -> Column:
    """``linear_map`` for a single frame array."""
    return linear_map(F.array(frame), matrix, "expr").getItem(0)


def interp_matrix(axis: Sequence[float], targets: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that linearly sample an axis at ``targets``; out-of-range targets give a zero row."""
    axis = np.asarray(axis, dtype=float)
    targets = np.asarray(targets, dtype=float)
    valid = (targets >= axis[0]) & (targets <= axis[-1])
    out = np.zeros((len(targets), len(axis)))
    for r in np.flatnonzero(valid):
        hi = min(max(int(np.searchsorted(axis, targets[r], side="left")), 1), len(axis) - 1)
        gap = axis[hi] - axis[hi - 1]
        a = (targets[r] - axis[hi - 1]) / gap if gap > 0 else 0.0
        out[r, hi - 1] += 1.0 - a
        out[r, hi] += a
    return out, valid


def smoothing_matrix(n: int, weights: Sequence[float]) -> np.ndarray:
    """Odd-length kernel along the channel axis with replicated edges."""
    r = len(weights) // 2
    out = np.zeros((n, n))
    for i in range(n):
        for j, w in enumerate(weights):
            out[i, min(max(i + j - r, 0), n - 1)] += w
    return out


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()
