"""Predicates and measures on boxes, as Column expressions. A box is four columns ``<p>x0 <p>y0 <p>x1 <p>y1`` named by a prefix; coordinates are points, origin top left, y down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))


def contains(big, small, margin: float = 1.0) -> Column:
    (a, b, c, d), (e, f, g, h) = big, small
    return (a - margin <= e) & (c + margin >= g) & (b - margin <= f) & (d + margin >= h)


def intersects_closed(p, q, margin: float = 0.0) -> Column:
    (a, b, c, d), (e, f, g, h) = p, q
    return ~((c + margin < e) | (g + margin < a) | (d + margin < f) | (h + margin < b))


def intersects_open(p, q, tolerance: float = 0.0) -> Column:
    return (x_overlap(p, q) > tolerance) & (y_overlap(p, q) > tolerance)


def same_box(p, q, tolerance: float = 0.05) -> Column:
    """All four sides within the tolerance."""
    out = F.lit(True)
    for a, b in zip(p, q, strict=True):
        out = out & (F.abs(a - b) <= tolerance)
    return out


def holds_point(b, x: Column, y: Column, margin: float = 0.0) -> Column:
    return (b[0] - margin <= x) & (x <= b[2] + margin) & (b[1] - margin <= y) & (y <= b[3] + margin)


def x_overlap(p, q) -> Column:
    """Signed: negative is a gap."""
    return F.least(p[2], q[2]) - F.greatest(p[0], q[0])


def y_overlap(p, q) -> Column:
    return F.least(p[3], q[3]) - F.greatest(p[1], q[1])


def area(b) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection_area(p, q) -> Column:
    return F.greatest(F.lit(0.0), x_overlap(p, q)) * F.greatest(F.lit(0.0), y_overlap(p, q))


def iou(p, q) -> Column:
    common = intersection_area(p, q)
    union = area(p) + area(q) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def collides(p, q, least_area: float = 2.0, share: float = 0.05) -> Column:
    """More than two square points and more than a twentieth of the smaller box."""
    return intersection_area(p, q) > F.greatest(F.lit(least_area), share * F.least(area(p), area(q)))


def interior_overlap(p, q) -> Column:
    return (x_overlap(p, q) > 1) & (y_overlap(p, q) > 1)


def is_full_width(b, frame, ratio: float = 0.64) -> Column:
    width = frame[2] - frame[0]
    return F.when(width > 0, (b[2] - b[0]) / width >= ratio).otherwise(False)


def centre(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def safety_margin(b) -> Column:
    """Eight hundredths of the short side, from 0.2 to 1.5 points."""
    return F.least(F.lit(1.5), F.greatest(F.lit(0.2), 0.08 * F.least(b[2] - b[0], b[3] - b[1])))


def flip_y(b, page_height: Column):
    """Bottom-left origin to top-left."""
    return b[0], page_height - b[3], b[2], page_height - b[1]


def rule_kind(b) -> Column:
    """A thin long box is a rule."""
    width, height = b[2] - b[0], b[3] - b[1]
    return F.when((height <= 3) & (width >= 4), "h_line").when((width <= 3) & (height >= 4), "v_line").otherwise("rectangle")
