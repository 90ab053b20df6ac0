"""Distances as Column expressions, and the NumPy kernels that give the same numbers.

Squared L2 has no root, the inner-product distance is 1 minus the product, and
cosine is that of normalised vectors.  Sums run in double precision in
component order, in both forms, so the two agree bit for bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm, so that a zero vector stays zero.
TINY = 1e-30


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_int(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors, as a long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def ip(a: Column, b: Column) -> Column:
    """Inner-product distance, 1 minus the product; can be negative."""
    return F.lit(1.0) - dot(a, b)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * (F.lit(1.0) / (norm(v) + F.lit(TINY))))


def cosine(a: Column, b: Column) -> Column:
    """Inner-product distance of the normalised vectors; 1 for a zero vector."""
    return F.lit(1.0) - dot(a, b) * (F.lit(1.0) / (norm(a) + F.lit(TINY))) * (F.lit(1.0) / (norm(b) + F.lit(TINY)))


EXPRESSIONS = {"l2": l2, "ip": ip, "cosine": cosine}
#: Sums of squares below it are whole numbers in double precision too.
WHOLE = 2.0**53


def with_kernel(space, kernel: str):
    """``space`` (Column, Column) -> Column, which orders points as the kernel of that name does ("l2", "l1", ...)."""
    space.kernel = kernel
    return space


l2_int = with_kernel(l2_int, "l2")


def kernel_of(metric, *vectors) -> str | None:
    """The kernel that orders points as ``metric`` does, if there is one; of integers those of ``vectors`` (DataFrames) must be small enough."""
    if metric is not l2_int:
        return metric if isinstance(metric, str) else getattr(metric, "kernel", None)
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.lit(4.0) * x.cast("double") * x.cast("double"))
    most = [df.agg(F.max(size)).first()[0] for df in vectors]
    return metric.kernel if all(m is None or m < WHOLE / 4 for m in most) else None


def distance(metric, a: Column, b: Column) -> Column:
    """``metric`` by name, or any callable (Column, Column) -> Column as a custom space."""
    if callable(metric):
        return metric(a, b)
    if metric not in EXPRESSIONS:
        raise ValueError(f"unknown space {metric!r}")
    return EXPRESSIONS[metric](a, b)


# -- kernels over matrices of rows


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed in component order."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def exact_pairs(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs, equal to the expressions bit for bit."""
    if metric == "l2":
        s = np.zeros(len(a))
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            s += d * d
        return s
    if metric == "l1":
        s = np.zeros(len(a))
        for j in range(a.shape[1]):
            s += np.abs(a[:, j] - b[:, j])
        return s
    if metric == "ip":
        return 1.0 - _dots(a, b)
    na = 1.0 / (np.sqrt(_dots(a, a)) + TINY)
    nb = 1.0 / (np.sqrt(_dots(b, b)) + TINY)
    return 1.0 - _dots(a, b) * na * nb


def rough(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) distances by one matrix product, exact up to rounding."""
    if metric == "cosine":
        q = q / (np.sqrt((q * q).sum(1, keepdims=True)) + TINY)
        x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + TINY)
    p = q @ x.T
    if metric == "l2":
        return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * p
    return 1.0 - p


def rounding(metric: str, q: np.ndarray, x: np.ndarray) -> float:
    """How far ``rough`` can be from the distance: it subtracts numbers of the size of the squared norms."""
    if metric == "cosine" or not len(q) or not len(x):
        return 1e-12
    most = float((q * q).sum(1).max()) + float((x * x).sum(1).max())
    return 4 * np.finfo(np.float64).eps * (q.shape[1] + 4) * most


@dataclass
class Side:
    """One side of the product of ``product``: its matrix, the same in single precision, its largest squared norm."""

    double: np.ndarray
    single: np.ndarray
    most: float


def _side(m: np.ndarray, norms: np.ndarray) -> Side:
    with np.errstate(over="ignore"):
        return Side(m, m.astype(np.float32), float(norms.max(initial=0.0)))


def _unit(metric: str, v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt((v * v).sum(1, keepdims=True)) + TINY) if metric == "cosine" else v


def left(metric: str, q: np.ndarray) -> Side:
    """The side of the queries."""
    if metric == "l1":
        return _side(q, np.abs(q).sum(1))
    q = _unit(metric, q)
    norms, ones = (q * q).sum(1), np.ones((len(q), 1))
    return _side(np.hstack([-2 * q, norms[:, None], ones]) if metric == "l2" else np.hstack([-q, ones]), norms)


def right(metric: str, x: np.ndarray) -> Side:
    """The side of the rows, a column each."""
    if metric == "l1":
        return _side(np.ascontiguousarray(x.T), np.abs(x).sum(1))
    x = _unit(metric, x)
    norms, ones = (x * x).sum(1), np.ones((len(x), 1))
    return _side(np.ascontiguousarray(np.hstack([x, ones, norms[:, None]] if metric == "l2" else [x, ones]).T), norms)


def fits_single(a: Side, b: Side) -> bool:
    """Whether single precision can hold the numbers of a product."""
    return a.most + b.most < 1e30  # not so for nan


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(queries, rows) sums of absolute differences, a few queries at a time so that they stay in the cache."""
    out = np.zeros((len(a), b.shape[1]), a.dtype)
    for i in range(0, len(a), 16):
        own, part = out[i : i + 16], np.empty((len(a[i : i + 16]), b.shape[1]), a.dtype)
        for j in range(len(b)):
            np.abs(np.subtract(a[i : i + 16, j, None], b[j], out=part), out=part)
            own += part
    return out


def product(metric: str, a: Side, b: Side, single: bool) -> tuple[np.ndarray, float]:
    """(queries, rows) distances by one product, and how far they can be from those of ``exact_pairs``."""
    scale = 1.0 + a.most + b.most
    times = _sums if metric == "l1" else np.matmul
    if single:
        return times(a.single, b.single), 4 * (len(b.single) + 8) * float(np.finfo(np.float32).eps) * scale
    with np.errstate(invalid="ignore", over="ignore"):
        return times(a.double, b.double), 1e-12 * scale + 4 * (len(b.double) + 8) * float(np.finfo(np.float64).eps) * scale


def places(hit: np.ndarray) -> np.ndarray:
    """The places of a matrix of booleans that are true, as of the flat one: few in many, so words of eight are looked at first."""
    flat = hit.ravel()
    n = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:n].view(np.uint64))
    i = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([i[flat[i]], n + np.flatnonzero(flat[n:])])
