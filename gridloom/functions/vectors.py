"""Column functions on ARRAY<DOUBLE> vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def rms_norm(v: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    """weight * v / sqrt(mean(v * v) + eps)."""
    scaled = lambda f: F.transform(v, lambda x: x * f)
    factor = 1.0 / F.sqrt(dot(v, v) / F.size(v) + F.lit(eps))
    out = scaled(factor)
    return out if weight is None else F.zip_with(out, weight, lambda x, w: x * w)


def rotate_half(v: Column) -> Column:
    """(-second half, first half)."""
    half = (F.size(v) / 2).cast("int")
    return F.concat(F.transform(F.slice(v, half + 1, half), lambda x: -x), F.slice(v, F.lit(1), half))


def angles_1d(position: Column, dim: int, base: float) -> Column:
    """position * base ** (-2 i / dim) for i < dim / 2, twice over."""
    one = F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda i: position * F.pow(F.lit(base), -2.0 * i / dim))
    return F.concat(one, one)


def angles_2d(row: Column, col: Column, dim: int, base: float = 1e4, layout: str = "hhww") -> Column:
    """Angles of a patch at (row, col).  hhww: the row's twice, then the column's twice; paired: row, column, row, column, which keeps lengths under rotate_half."""
    half = dim // 2
    of = lambda p: F.transform(F.sequence(F.lit(0), F.lit(half // 2 - 1)), lambda i: p * F.pow(F.lit(base), -2.0 * i / half))
    h, w = of(row), of(col)
    return F.concat(h, h, w, w) if layout == "hhww" else F.concat(h, w, h, w)


def rotate(v: Column, angles: Column) -> Column:
    """v * cos + rotate_half(v) * sin."""
    kept = F.zip_with(v, angles, lambda x, t: x * F.cos(t))
    turned = F.zip_with(rotate_half(v), angles, lambda x, t: x * F.sin(t))
    return F.zip_with(kept, turned, lambda x, y: x + y)


def silu(x: Column) -> Column:
    return x / (1.0 + F.exp(-x))


def linear(v: Column, weight: Column, bias: Column | None = None) -> Column:
    """weight (array of rows) times v, and the bias added; for small matrices, others go through operators.models."""
    out = F.transform(weight, lambda row: dot(row, v))
    return out if bias is None else F.zip_with(out, bias, lambda x, b: x + b)


def swiglu(v: Column, gate: Column, up: Column, down: Column) -> Column:
    """down(silu(gate v) * up v), without bias."""
    inner = F.zip_with(linear(v, gate), linear(v, up), lambda g, u: silu(g) * u)
    return F.transform(F.array(inner), lambda hidden: linear(hidden, down))[0]  # bound, so that it is made once


def matrix(rows) -> Column:
    """A matrix as a constant."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
