"""Axis-aligned boxes (x1, y1, x2, y2) as column expressions.

Intersections and unions are written in one fixed order of operations, so that results are the same doubles wherever
they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _c(alias: str, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def box_area(alias: str = "") -> Column:
    return (_c(alias, "x2") - _c(alias, "x1")) * (_c(alias, "y2") - _c(alias, "y1"))


def overlap_area(a: str, b: str) -> Column:
    """Area common to both boxes; 0 where they don't overlap."""
    w = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    h = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where the union isn't positive."""
    inter = overlap_area(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def over_smaller(a: str, b: str) -> Column:
    """Intersection over the smaller area; 0 where that isn't positive."""
    inter, small = overlap_area(a, b), F.least(box_area(a), box_area(b))
    return F.when((inter > 0) & (small > 0), inter / small).otherwise(F.lit(0.0))


def overlaps(a: str, b: str, closed: bool = True) -> Column:
    """Closed overlap counts touching boxes, open overlap doesn't."""
    if closed:
        return (_c(a, "x1") <= _c(b, "x2")) & (_c(b, "x1") <= _c(a, "x2")) & (_c(a, "y1") <= _c(b, "y2")) & (_c(b, "y1") <= _c(a, "y2"))
    return (_c(a, "x1") < _c(b, "x2")) & (_c(b, "x1") < _c(a, "x2")) & (_c(a, "y1") < _c(b, "y2")) & (_c(b, "y1") < _c(a, "y2"))


def box_ring() -> Column:
    """The box as a flat ring of four corners; null where a side is missing."""
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    ok = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(ok, F.array(x1, y1, x2, y1, x2, y2, x1, y2))
