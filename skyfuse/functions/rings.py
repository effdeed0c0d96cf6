"""Rings as flat arrays [x0, y0, x1, y1, ...] and segmentations as arrays of rings: column expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xs(ring: Column) -> Column:
    return F.filter(ring, lambda v, i: i % 2 == 0)


def ys(ring: Column) -> Column:
    return F.filter(ring, lambda v, i: i % 2 == 1)


def valid_ring(ring: Column) -> Column:
    """At least three points, an even number of values."""
    return ring.isNotNull() & (F.size(ring) >= 6) & (F.size(ring) % 2 == 0)


def points(ring: Column) -> Column:
    """Array of (x, y); empty for rings that aren't valid."""
    pairs = F.zip_with(xs(ring), ys(ring), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(valid_ring(ring), pairs).otherwise(F.slice(pairs, 1, 0))


def flat(pts: Column) -> Column:
    """Inverse of ``points``."""
    return F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"])))


def shifted(seg: Column, dx: Column, dy: Column) -> Column:
    """Segmentation moved by (dx, dy); rings under three points are dropped."""
    kept = F.filter(seg, lambda r: F.size(r) >= 6)
    return F.transform(kept, lambda r: F.transform(r, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy)))


def affine(seg: Column, gt: list[Column]) -> Column:
    """Segmentation through x' = g0 + x g1 + y g2, y' = g3 + x g4 + y g5; rings under three points are dropped."""
    kept = F.filter(seg, lambda r: F.size(r) >= 6)
    moved = lambda p: F.struct((gt[0] + p["x"] * gt[1] + p["y"] * gt[2]).alias("x"), (gt[3] + p["x"] * gt[4] + p["y"] * gt[5]).alias("y"))
    return F.transform(kept, lambda r: flat(F.transform(points(r), moved)))


def cleaned(seg: Column) -> Column:
    """Segmentation without repeated end points and without rings under three points; null where no ring is left."""
    open_ = F.transform(seg, lambda r: F.when((F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -2)) & (F.element_at(r, 2) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 2)).otherwise(r))
    kept = F.filter(open_, lambda r: F.coalesce(valid_ring(r), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def bounds(seg: Column) -> Column:
    """Struct (x1, y1, x2, y2) over all rings; zeros where there are none."""
    x, y = F.flatten(F.transform(seg, xs)), F.flatten(F.transform(seg, ys))
    zero = F.lit(0.0)
    return F.struct(F.coalesce(F.array_min(x), zero).alias("x1"), F.coalesce(F.array_min(y), zero).alias("y1"), F.coalesce(F.array_max(x), zero).alias("x2"), F.coalesce(F.array_max(y), zero).alias("y2"))


def _edges(ring: Column) -> Column:
    """Array of (x, y, u, v): each point with the next one, the last with the first."""
    p = points(ring)
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    return F.zip_with(p, nxt, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("u"), b["y"].alias("v")))


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + of(e))


def signed_area(ring: Column) -> Column:
    """Shoelace; closed by itself; 0 for rings that aren't valid."""
    return _total(_edges(ring), lambda e: e["x"] * e["v"] - e["u"] * e["y"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Struct (x, y) of the area's centre; null for rings without area."""
    e, a = _edges(ring), signed_area(ring)
    cross = lambda q: q["x"] * q["v"] - q["u"] * q["y"]
    x = _total(e, lambda q: (q["x"] + q["u"]) * cross(q)) / (6 * a)
    y = _total(e, lambda q: (q["y"] + q["v"]) * cross(q)) / (6 * a)
    return F.when(a != 0, F.struct(x.alias("x"), y.alias("y")))
