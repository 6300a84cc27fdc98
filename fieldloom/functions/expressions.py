"""Column expressions: scalars of tensors, warps, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for a missing value however it is written (NULL, NaN, infinity)."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def effective(xx: Column, yy: Column, xy: Column) -> Column:
    """sqrt(max(2/3 (xx^2 + yy^2 + 2 xy^2 - xx yy), 0)); NULL if a component is."""
    inner = F.lit(2.0) / 3.0 * (xx * xx + yy * yy + 2.0 * xy * xy - xx * yy)
    return F.when(inner.isNotNull(), F.sqrt(F.greatest(inner, F.lit(0.0))))


def compose_affine(p: list[Column], d: list[Column]) -> list[Column]:
    """p after the inverse of d; both are u, v, du_dx, du_dy, dv_dx, dv_dy. NULL where d has no inverse."""
    u, v, ux, uy, vx, vy = p
    du, dv, dux, duy, dvx, dvy = d
    a, b, c, e = 1 + dux, duy, dvx, 1 + dvy
    det = a * e - b * c
    det = F.when(F.abs(det) >= 1e-12, det)
    ia, ib, ic, ie = e / det, -b / det, -c / det, a / det
    iu, iv = -(ia * du + ib * dv), -(ic * du + ie * dv)
    m11, m12, m21, m22 = 1 + ux, uy, vx, 1 + vy
    out = [m11 * iu + m12 * iv + u, m21 * iu + m22 * iv + v, m11 * ia + m12 * ic - 1, m11 * ib + m12 * ie, m21 * ia + m22 * ic, m21 * ib + m22 * ie - 1]
    return out


def extrapolate(p: list[Column], dx: Column, dy: Column) -> tuple[Column, Column]:
    """u and v that a neighbour at (dx, dy) starts from."""
    u, v, ux, uy, vx, vy = p
    return u + ux * dx + uy * dy, v + vx * dx + vy * dy


def accepted(corr: Column, u: Column, v: Column, u0: Column, v0: Column, spacing: int, cutoff: float) -> Column:
    return (corr < cutoff) & (F.abs(u - u0) < spacing + 1) & (F.abs(v - v0) < spacing + 1)


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd crossing of a ray towards larger x."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside + cross.cast("int")
    return inside % 2 == 1


def on_edge(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Whether the point lies on an edge of the polygon."""
    hit = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        hit = hit | (((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return hit


def symmetric(lo: Column, hi: Column) -> tuple[Column, Column]:
    m = F.greatest(F.abs(lo), F.abs(hi))
    return -m, m


def widened(lo: Column, hi: Column) -> Column:
    """The upper end of a range, moved a little where the range is empty."""
    return F.when(lo == hi, hi + 1e-12).otherwise(hi)


def normalised(c: Column, lo: Column, hi: Column) -> Column:
    """c's place between lo and hi, clipped to [0, 1]; in an empty range 0 up to its value and 1 above."""
    span = F.when(hi > lo, hi - lo)
    inside = F.least(F.greatest((c - lo) / span, F.lit(0.0)), F.lit(1.0))
    return F.when(c.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.when(span.isNotNull(), inside).otherwise((c > lo).cast("double")))
