"""Column functions on boxes: (x1, y1, x2, y2), inclusive corners, area (x2 - x1) * (y2 - y1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations of a to b (fixed values).
IN, APART, HOLDS, MEETS = -1, 0, 1, 2


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)


def overlap(a: Box, b: Box, bias: tuple[int, int] = (0, 0)) -> Column:
    """Area of the intersection; each side of it moved out by the bias."""
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + 2 * bias[0]
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + 2 * bias[1]
    zero = F.lit(0).cast("long")
    return F.greatest(w, zero) * F.greatest(h, zero)


def relation(a: Box, b: Box, bias: tuple[int, int] = (0, 0)) -> Column:
    """-1 a in b (also if they are equal), 1 b in a, 2 they share enough (2 % of the union, over 20 % of either), else 0.

    In integers, so no ratio is rounded and boxes without area divide nothing.
    """
    common = overlap(a, b, bias)
    union = a.area + b.area - common
    return (
        F.when(common == 0, APART)
        .when(common >= a.area, IN)
        .when(common >= b.area, HOLDS)
        .when((50 * common >= union) | (5 * common > a.area) | (5 * common > b.area), MEETS)
        .otherwise(APART)
    )


def holds(a: Box, b: Box) -> Column:
    """b is in a or equal to it, and has an area: relation() by sides, for joins that ask it of many pairs."""
    return (a.x1 <= b.x1) & (a.x2 >= b.x2) & (a.y1 <= b.y1) & (a.y2 >= b.y2) & (b.x1 < b.x2) & (b.y1 < b.y2)


def relation_strict(a: Box, b: Box) -> Column:
    """-1 a strictly inside b, 1 b strictly inside a, 0 no common point, else 2."""
    inside = lambda p, q: (p.x1 > q.x1) & (p.y1 > q.y1) & (p.x2 < q.x2) & (p.y2 < q.y2)
    apart = (F.greatest(a.x1, b.x1) > F.least(a.x2, b.x2)) | (F.greatest(a.y1, b.y1) > F.least(a.y2, b.y2))
    return F.when(inside(a, b), IN).when(inside(b, a), HOLDS).when(apart, APART).otherwise(MEETS)


def close(a: Box, b: Box, distance: int) -> Column:
    """Common rows, and facing sides nearer than the distance; boxes far inside each other are not close."""
    rows = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return (rows > 0) & (F.least(F.abs(a.x1 - b.x2), F.abs(b.x1 - a.x2)) < distance)


def union_box(a: Box, b: Box) -> list[Column]:
    return [F.least(a.x1, b.x1).alias("x1"), F.least(a.y1, b.y1).alias("y1"), F.greatest(a.x2, b.x2).alias("x2"), F.greatest(a.y2, b.y2).alias("y2")]
