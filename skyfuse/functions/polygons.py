"""Areas of general polygons without a geometry library: numpy kernels and their Arrow wrappers.

A segmentation is a list of flat rings, the first the shell and the others its holes.  Areas of intersections and
unions come from vertical slabs between all corner and crossing abscissas: inside a slab no edges cross, so its edges
have one order, and winding numbers along it tell the inside.  Rings are turned to positive orientation and the
inside is where their winding is positive, which is also the repair of rings that cross themselves: the lobe that
agrees with the ring's own orientation stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import iou, over_smaller, overlap_area


def ring_points(ring) -> np.ndarray:
    """Points of a flat ring without a repeated end; none for an odd count or under three points."""
    if ring is None or len(ring) < 6 or len(ring) % 2:
        return np.zeros((0, 2))
    p = np.asarray(ring, float).reshape(-1, 2)
    if (p[0] == p[-1]).all():
        p = p[:-1]
    return p if len(p) >= 3 and np.isfinite(p).all() else np.zeros((0, 2))


def shoelace(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def edges(seg) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of a segmentation, the shell counter-clockwise, holes clockwise; none without a valid shell."""
    out = []
    for k, ring in enumerate(seg if seg is not None else []):
        p = ring_points(ring)
        if not len(p):
            if k == 0:
                return np.zeros((0, 4))
            continue
        if (shoelace(p) < 0) == (k == 0):
            p = p[::-1]
        out.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    return np.vstack(out) if out else np.zeros((0, 4))


def _crossings(e: np.ndarray) -> np.ndarray:
    """Abscissas where edges cross each other."""
    d = e[:, 2:] - e[:, :2]
    i, j = np.triu_indices(len(e), 1)
    box = (np.minimum(e[i, 0], e[i, 2]) <= np.maximum(e[j, 0], e[j, 2])) & (np.minimum(e[j, 0], e[j, 2]) <= np.maximum(e[i, 0], e[i, 2]))
    i, j = i[box], j[box]
    cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    i, j, cross = i[cross != 0], j[cross != 0], cross[cross != 0]
    w = e[j, :2] - e[i, :2]
    s = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / cross
    t = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
    ok = (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    return e[i[ok], 0] + s[ok] * d[i[ok], 0]


def region_area(shapes: list[np.ndarray], inside) -> float:
    """Area where ``inside`` holds of the shapes' winding numbers (an array of one column for each shape)."""
    e = np.vstack(shapes) if shapes else np.zeros((0, 4))
    if not len(e):
        return 0.0
    owner = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    x = np.unique(np.concatenate([e[:, 0], e[:, 2], _crossings(e)]))
    slope_dx = e[:, 2] - e[:, 0]
    total = 0.0
    for a, b in zip(x[:-1], x[1:], strict=True):
        m = (a + b) / 2
        span = np.flatnonzero((np.minimum(e[:, 0], e[:, 2]) < m) & (np.maximum(e[:, 0], e[:, 2]) > m))
        if len(span) < 2:
            continue
        y = e[span, 1] + (m - e[span, 0]) * (e[span, 3] - e[span, 1]) / slope_dx[span]
        order = np.argsort(y, kind="stable")
        span, y = span[order], y[order]
        turn = np.zeros((len(span), len(shapes)))
        turn[np.arange(len(span)), owner[span]] = np.sign(slope_dx[span])
        wind = np.cumsum(turn, axis=0)[:-1]
        total += (b - a) * float((np.diff(y) * inside(wind)).sum())
    return total


def crosses_itself(seg) -> bool:
    """Whether non-neighbouring edges of a ring meet."""
    for ring in seg if seg is not None else []:
        p = ring_points(ring)
        n = len(p)
        if n < 4:
            continue
        e = np.hstack([p, np.roll(p, -1, axis=0)])
        for k in range(n):
            rest = [j for j in range(k + 2, n) if not (k == 0 and j == n - 1)]
            for j in rest:
                if len(_crossings(e[[k, j]])):
                    return True
    return False


def polygon_area(seg) -> float:
    """Shell less holes; rings that cross themselves count what their repair keeps."""
    if crosses_itself(seg):
        return region_area([edges(seg)], lambda w: w[:, 0] > 0)
    parts = [abs(shoelace(ring_points(r))) for r in (seg if seg is not None else [])]
    return max(0.0, parts[0] - sum(parts[1:])) if parts else 0.0


def intersection_area(a, b) -> float:
    return region_area([edges(a), edges(b)], lambda w: (w[:, 0] > 0) & (w[:, 1] > 0))


def union_area(segs) -> float:
    """Area covered by any of the polygons; those that aren't valid are skipped."""
    shapes = [e for e in map(edges, segs) if len(e)]
    return region_area(shapes, lambda w: (w > 0).any(axis=1))


def covered_areas(a: list[np.ndarray], b: list[np.ndarray], window) -> tuple[float, float, float]:
    """Area that any polygon of a, any of b, and both cover inside a window (x1, y1, x2, y2), from lists of ``indicator_edges``: one sweep over slabs."""
    x1, y1, x2, y2 = window
    sides = [(np.vstack(s) if s else np.zeros((0, 4))) for s in (a, b)]
    e, owner = np.vstack(sides), np.repeat([0, 1], [len(s) for s in sides])
    clip = (np.maximum(e[:, 0], e[:, 2]) > x1) & (np.minimum(e[:, 0], e[:, 2]) < x2) & (e[:, 0] != e[:, 2])
    e, owner = e[clip], owner[clip]
    if not len(e):
        return 0.0, 0.0, 0.0
    box = np.array([[x1, y1, x2, y1], [x1, y2, x2, y2]])
    x = np.unique(np.clip(np.concatenate([e[:, 0], e[:, 2], _crossings(np.vstack([e, box])), [x1, x2]]), x1, x2))
    slope, sign = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]), np.sign(e[:, 2] - e[:, 0])
    lo, hi, out = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.zeros(3)
    for p, q in zip(x[:-1], x[1:], strict=True):
        m = (p + q) / 2
        span = np.flatnonzero((lo < m) & (hi > m))
        if len(span) < 2:
            continue
        y = e[span, 1] + (m - e[span, 0]) * slope[span]
        order = np.argsort(y, kind="stable")
        span, y = span[order], np.clip(y[order], y1, y2)
        on = [np.cumsum(np.where(owner[span] == k, sign[span], 0))[:-1] > 0 for k in (0, 1)]
        h = np.diff(y) * (q - p)
        out += [h[on[0]].sum(), h[on[1]].sum(), h[on[0] & on[1]].sum()]
    return tuple(out.tolist())


def bbox_iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def pair_overlap(seg_a, box_a, seg_b, box_b) -> tuple[float, float, float]:
    """(iou, intersection over the smaller, intersection) of two features; by their boxes, with no intersection told, where a ring is missing or an area not positive."""
    a, b = edges(seg_a), edges(seg_b)
    if len(a) and len(b):
        area_a, area_b = polygon_area(seg_a), polygon_area(seg_b)
        inter = region_area([a, b], lambda w: (w[:, 0] > 0) & (w[:, 1] > 0))
        union, small = area_a + area_b - inter, min(area_a, area_b)
        if union > 0:
            return inter / union, inter / small if small > 0 else 0.0, inter
    v = bbox_iou(box_a, box_b)
    return v, v, 0.0


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def chain(points):
        out: list[tuple[float, float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]), float)


def smallest_rectangle(ring) -> tuple[float, float, float, np.ndarray]:
    """(width, height, area, corners) of the smallest rectangle around a ring, at any angle; zeros for rings that aren't valid."""
    p = ring_points(ring)
    h = hull(p) if len(p) else p
    if len(h) < 3:
        return 0.0, 0.0, 0.0, np.zeros((4, 2))
    d = np.roll(h, -1, axis=0) - h
    u = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    along, across = h @ u.T, h @ np.stack([-u[:, 1], u[:, 0]])
    w, v = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = int(np.argmin(w * v))
    axes = np.array([u[k], [-u[k, 1], u[k, 0]]])
    lo, hi = (along[:, k].min(), across[:, k].min()), (along[:, k].max(), across[:, k].max())
    corners = np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ axes
    return float(w[k]), float(v[k]), float(w[k] * v[k]), corners


# ---- Arrow wrappers

def overlap_columns(seg_a: Column, box_a: Column, seg_b: Column, box_b: Column) -> Column:
    """Struct (iou, ios, inter) of two polygon columns; boxes are arrays of four."""

    @F.pandas_udf("iou double, ios double, inter double")
    def run(sa, ba, sb, bb):
        import pandas as pd

        return pd.DataFrame([pair_overlap(*x) for x in zip(sa, ba, sb, bb, strict=True)], columns=["iou", "ios", "inter"], dtype=float)

    return run(seg_a, box_a, seg_b, box_b)


def shape_columns(seg: Column) -> Column:
    """Struct (area, rect_w, rect_h, rect_area) of a polygon column."""

    @F.pandas_udf("area double, rect_w double, rect_h double, rect_area double")
    def run(s):
        import pandas as pd

        return pd.DataFrame([(polygon_area(x), *smallest_rectangle(x[0] if x is not None and len(x) else None)[:3]) for x in s], columns=["area", "rect_w", "rect_h", "rect_area"], dtype=float)

    return run(seg)


# ---- signed edges: areas of common parts as column expressions

EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double,s:double>>"


def signed_edges(seg) -> list[tuple[float, float, float, float, float]] | None:
    """Edges from left to right with a sign, so that the signs of the edges above a point add up to 1 inside the polygon and 0 outside; None without a valid shell.

    Rings that cross themselves, and holes, come as the slabs of what their repair keeps.
    """
    e = edges(seg)
    if not len(e):
        return None
    if len(seg) > 1 or crosses_itself(seg):
        return _slab_edges(e)
    e = e[e[:, 0] != e[:, 2]]
    left = e[:, 0] < e[:, 2]  # counter-clockwise: the lower side runs to the right
    return [(*(p if a else (p[2], p[3], p[0], p[1])), -1.0 if a else 1.0) for p, a in zip(e.tolist(), left.tolist(), strict=True)]


def many_signed_edges(segs: list) -> list[np.ndarray | None]:
    """``signed_edges`` of many segmentations: single convex rings of as many points go together, the others one by one."""
    out: list[np.ndarray | None] = [None] * len(segs)
    by_size: dict[int, list[int]] = {}
    for k, seg in enumerate(segs):
        if seg and len(seg) == 1 and seg[0] is not None and len(seg[0]) in (6, 8, 10, 12) and None not in seg[0]:
            ring = seg[0]
            by_size.setdefault(len(ring) - 2 * (ring[:2] == ring[-2:]), []).append(k)
    slow = set(range(len(segs)))
    for n, who in by_size.items():
        if n < 6:
            continue
        ok, rows = _convex_edges(np.array([segs[k][0][:n] for k in who], float))
        for j in np.flatnonzero(ok).tolist():
            r = rows[j]
            out[who[j]] = r[r[:, 0] != r[:, 2]]
            slow.discard(who[j])
    for k in slow:
        got = signed_edges(segs[k])
        out[k] = np.array(got, float).reshape(-1, 5) if got else None
    return out


def _convex_edges(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rings are convex, their signed edges) of rings of as many points, one a row."""
    p = rings.reshape(len(rings), -1, 2)
    q = np.roll(p, -1, axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        d = q - p
        e = np.roll(d, -1, axis=1)
        turn, along = d[:, :, 0] * e[:, :, 1] - d[:, :, 1] * e[:, :, 0], (d * e).sum(axis=2)
        # convex: it turns one way only, and once around
        ok = np.isfinite(p).all(axis=(1, 2)) & ((turn > 0).all(axis=1) | (turn < 0).all(axis=1)) & (np.abs(np.arctan2(turn, along).sum(axis=1)) < 6.5)
    flip = d[:, :, :1] < 0
    left, right = np.where(flip, q, p), np.where(flip, p, q)
    up = np.where(flip[:, :, 0], 1.0, -1.0) * np.sign(turn[:, :1])
    return ok, np.concatenate([left, right, up[:, :, None]], axis=2)


def _box_rings(rings: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which rings of four points (eight values a row) are their boxes, from any corner and either way round."""
    p = rings.reshape(len(rings), 4, 2)
    high = p == box[:, None, 2:]
    ok = (high | (p == box[:, None, :2])).all(axis=(1, 2)) & (box[:, :2] < box[:, 2:]).all(axis=1)
    c = 2 * high[:, :, 0] + high[:, :, 1]
    return ok & (c[:, 0] ^ c[:, 2] == 3) & (c[:, 1] ^ c[:, 3] == 3) & np.isin(c[:, 0] ^ c[:, 1], (1, 2))


def arrow_edges(seg, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of signed edges, the edges one after the other, areas, whether the ring is the box) of an Arrow column of segmentations: what ``with_shapes`` tells of them.

    Rows without a valid shell or area have no edges.
    """
    n = len(seg)
    parts, slow, plain, base = [], np.ones(n, bool), np.zeros(n, bool), box[:, 1]
    inner = seg.flatten()
    lengths = np.asarray(inner.value_lengths().fill_null(0), np.int64)
    values = inner.flatten()
    if values.null_count == 0 and inner.null_count == 0:
        rings = np.asarray(seg.value_lengths().fill_null(0), np.int64)
        first = np.cumsum(rings) - rings
        one = np.flatnonzero(rings == 1)
        flat = values.to_numpy(zero_copy_only=False)
        start, size = (np.cumsum(lengths) - lengths)[first[one]], lengths[first[one]]
        for k in (6, 8, 10, 12):
            who = size == k
            if not who.any():
                continue
            at, row = start[who], one[who]
            if k in (8, 10):
                plain[row] = _box_rings(flat[at[:, None] + np.arange(8)], box[row])
            shut = (flat[at] == flat[at + k - 2]) & (flat[at + 1] == flat[at + k - 1])
            for m, on in ((k, ~shut), (k - 2, shut)):
                if m < 6 or not on.any():
                    continue
                ok, e = _convex_edges(flat[at[on][:, None] + np.arange(m)])
                e, who_ok = e[ok], row[on][ok]
                slow[who_ok] = False
                up = e[:, :, 0] != e[:, :, 2]
                parts.append((np.repeat(who_ok, up.sum(axis=1)), e[up]))
    rest = np.flatnonzero(slow)
    if len(rest):
        segs = seg.to_pylist() if len(rest) == n else [seg[int(k)].as_py() for k in rest]
        rings = [(k, s[0][:8]) for k, s in zip(rest.tolist(), segs, strict=True) if s and len(s) == 1 and s[0] is not None and len(s[0]) in (8, 10) and None not in s[0][:8]]
        if rings:
            row = [k for k, _ in rings]
            plain[row] = _box_rings(np.array([r for _, r in rings], float), box[row])
        got = [(k, g) for k, g in zip(rest.tolist(), many_signed_edges(segs), strict=True) if g is not None and len(g)]
        if got:
            parts.append((np.repeat([k for k, _ in got], [len(g) for _, g in got]), np.concatenate([g for _, g in got])))
    row = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    edge = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, 5))
    order = np.argsort(row, kind="stable")
    row, edge = row[order], edge[order]
    area = np.bincount(row, edge[:, 4] * (edge[:, 2] - edge[:, 0]) * ((edge[:, 1] - base[row]) + (edge[:, 3] - base[row])) / 2, n) if n else np.zeros(0)
    on = (area > 0)[row]
    sizes = np.bincount(row[on], minlength=n)
    return sizes, edge[on], np.where(area > 0, area, 0.0), plain


def indicator_edges(segs: list) -> list[np.ndarray]:
    """Edges (x1, y1, x2, y2) of the valid ones, whose winding number is 1 inside and 0 outside, also for rings that cross themselves."""
    return [np.where(g[:, 4:] < 0, g[:, :4], g[:, [2, 3, 0, 1]]) for g in many_signed_edges(segs) if g is not None and len(g)]


def _slab_edges(e: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    """Upper and lower sides of the trapezoids in which the winding number is positive."""
    out, x = [], np.unique(np.concatenate([e[:, 0], e[:, 2], _crossings(e)]))
    dx = e[:, 2] - e[:, 0]
    for a, b in zip(x[:-1].tolist(), x[1:].tolist(), strict=True):
        m = (a + b) / 2
        span = np.flatnonzero((np.minimum(e[:, 0], e[:, 2]) < m) & (np.maximum(e[:, 0], e[:, 2]) > m))
        at = lambda v, k: float(e[k, 1] + (v - e[k, 0]) * (e[k, 3] - e[k, 1]) / dx[k])  # noqa: B023, E731
        span = span[np.argsort([at(m, k) for k in span], kind="stable")]
        inside = np.cumsum(np.sign(dx[span])) > 0
        for low, high, on in zip(span[:-1], span[1:], inside[:-1], strict=True):
            if on:
                out += [(a, at(a, low), b, at(b, low), -1.0), (a, at(a, high), b, at(b, high), 1.0)]
    return out


def with_shapes(f: DataFrame) -> DataFrame:
    """f(seg, x1..y2) with ``edge`` (signed edges, null without a valid shell), ``area``, ``box`` (whether the ring is the box) and the bounds of x + y and x - y; only rows whose ring isn't their box go through Python.

    A null ring, or one without area, leaves both null: such a row counts by its box.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ring = F.element_at("seg", 1)
    ends = F.when(F.size(ring) == 10, F.slice(ring, 1, 8)).otherwise(ring)
    turns = [F.array(*[c for k in range(4) for c in corners[(k + at) % 4]]) for corners in (((x1, y1), (x2, y1), (x2, y2), (x1, y2)), ((x1, y1), (x1, y2), (x2, y2), (x2, y1))) for at in range(4)]
    # the first corner tells most rings apart, without the eight arrays
    corner = F.element_at(ring, 1).isin(x1, x2) & F.element_at(ring, 2).isin(y1, y2)
    is_box = F.coalesce((F.size("seg") == 1) & (x1 < x2) & (y1 < y2) & (F.size(ring) > 1) & corner & ends.isin(*turns), F.lit(False))
    side = lambda y, s: F.struct(x1.alias("x1"), y.alias("y1"), x2.alias("x2"), y.alias("y2"), F.lit(s).alias("s"))
    boxes = f.where(is_box).withColumn("edge", F.array(side(y2, 1.0), side(y1, -1.0)).cast(EDGES))

    rest = f.where(~is_box).withColumn("edge", F.lit(None).cast(EDGES))
    at = rest.columns.index("seg")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2", "s")]))
        for batch in batches:
            got = many_signed_edges(batch.column(at).to_pylist())
            flat = np.concatenate([g for g in got if g is not None] or [np.zeros((0, 5))])
            ends = np.cumsum([0 if g is None else len(g) for g in got])
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(5)], ["x1", "y1", "x2", "y2", "s"])
            made = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), parts, mask=pa.array([g is None for g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made.cast(kind)], batch.schema.names)

    others = rest.mapInArrow(run, rest.schema)
    # under the least y of the box, so that map coordinates don't swallow the digits
    area = F.aggregate("edge", F.lit(0.0), lambda a, e: a + e["s"] * (e["x2"] - e["x1"]) * ((e["y1"] - y1) + (e["y2"] - y1)) / 2)
    out = boxes.withColumn("box", F.lit(True)).unionByName(others.withColumn("box", F.lit(False))).withColumn("area", area)
    ends = lambda of: F.transform("edge", lambda e: F.array(of(e["x1"], e["y1"]), of(e["x2"], e["y2"])))
    plus, minus = F.flatten(ends(lambda x, y: x + y)), F.flatten(ends(lambda x, y: x - y))
    out = out.withColumn("edge", F.when(F.col("area") > 0, F.col("edge"))).withColumn("area", F.when(F.col("area") > 0, F.col("area")))
    return out.withColumns({"u1": F.array_min(plus), "u2": F.array_max(plus), "v1": F.array_min(minus), "v2": F.array_max(minus)})


def common_areas(ea, eb, base) -> np.ndarray:
    """Areas common to many pairs of polygons: over every pair of their edges, what lies under both of them.

    ``ea`` and ``eb``: (numbers of edges, edges of all pairs as columns x1, y1, x2, y2, s); base: heights under both.
    """
    (na, a), (nb, b) = ea, eb
    out, n = np.zeros(len(na)), na * nb
    if not len(n):
        return out
    sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
    lots = np.cumsum(n) // 500_000
    for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.flatnonzero(np.r_[True, lots[1:] != lots[:-1], True])), strict=True):
        m = n[lo:hi]
        pair = np.repeat(np.arange(lo, hi), m)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
        e, f = a[sa[pair] + k // nb[pair]], b[sb[pair] + k % nb[pair]]
        x, y = np.maximum(e[:, 0], f[:, 0]), np.minimum(e[:, 2], f[:, 2])
        on = y > x
        e, f, x, y, pair = e[on], f[on], x[on], y[on], pair[on]
        at = lambda q, v: (q[:, 1] - base[pair]) + (v - q[:, 0]) * (q[:, 3] - q[:, 1]) / (q[:, 2] - q[:, 0])  # noqa: B023, E731
        # heights at both ends; where the edges cross between, the lower one changes
        el, fl, eh, fh = at(e, x), at(f, x), at(e, y), at(f, y)
        dl, dh = el - fl, eh - fh
        both = dl * dh
        cross = np.where(both < 0, both / np.maximum(np.abs(dl) + np.abs(dh), 1e-300), 0.0)
        out += np.bincount(pair, e[:, 4] * f[:, 4] * (np.minimum(el, fl) + np.minimum(eh, fh) - cross) * (y - x) / 2, len(out))
    return np.maximum(out, 0.0)


def pair_columns(a: str = "a", b: str = "b") -> list[Column]:
    """What ``shape_overlaps`` needs of pairs of rows ``with_shapes``."""
    both = {"_ea": F.col(f"{a}.edge"), "_eb": F.col(f"{b}.edge"), "_aa": F.col(f"{a}.area"), "_ab": F.col(f"{b}.area"), "_base": F.least(f"{a}.y1", f"{b}.y1"), "_plain": F.col(f"{a}.box") & F.col(f"{b}.box")}
    return [c.alias(k) for k, c in (both | {"_iou": iou(a, b), "_ios": over_smaller(a, b), "_inter": overlap_area(a, b)}).items()]


def could_overlap(a: str, b: str, threshold: float, smaller: bool = False) -> Column:
    """Whether boxes, boxes at 45 degrees and areas leave room for an IoU (or common part of the ``smaller``) above the threshold, to within rounding."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(f"{a}.{k}2", f"{b}.{k}2") - F.greatest(f"{a}.{k}1", f"{b}.{k}1"))
    one, two = F.col(f"{a}.area"), F.col(f"{b}.area")
    most = F.least(overlap_area(a, b), side("u") * side("v") / 2, one, two)
    room = most * (1 + 1e-9) > F.lit(float(threshold)) * (F.least(one, two) if smaller else one + two - most)
    return F.coalesce(room, F.lit(True))


def shape_overlaps(pairs: DataFrame) -> DataFrame:
    """pairs(..., ``pair_columns``) -> (..., iou, ios, inter): of the polygons; of the boxes where both rings are their boxes or one is missing (then ios is the IoU too)."""
    keep = [f for f in pairs.schema.fields if not f.name.startswith("_")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            col = {k: batch.column(k) for k in ("_ea", "_eb", "_aa", "_ab", "_base", "_iou", "_ios", "_inter")}
            size, flat = [], []
            for k in ("_ea", "_eb"):
                size.append(np.asarray(col[k].value_lengths().fill_null(0), np.int64))
                e = col[k].flatten()
                flat.append(np.stack([np.asarray(e.field(j), float) for j in range(5)], axis=1))
            box = [np.asarray(col[k], float) for k in ("_iou", "_ios", "_inter")]
            area = [np.asarray(col[k].fill_null(0), float) for k in ("_aa", "_ab")]
            shaped, plain = (size[0] > 0) & (size[1] > 0), batch.column("_plain").to_numpy(zero_copy_only=False).astype(bool)
            go = shaped & ~plain
            some = [(n[go], x[np.repeat(go, n)]) for n, x in zip(size, flat, strict=True)]
            inter = box[2].copy()
            inter[go] = common_areas(*some, np.asarray(col["_base"], float)[go])
            union, small = area[0] + area[1] - inter, np.minimum(*area)
            with np.errstate(divide="ignore", invalid="ignore"):
                ious = np.where(go, np.where(union > 0, inter / union, 0.0), box[0])
                ios = np.where(go, np.where(small > 0, inter / small, 0.0), np.where(plain, box[1], box[0]))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(ious), pa.array(ios), pa.array(inter)], [*[f.name for f in keep], "iou", "ios", "inter"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["iou double, ios double, inter double"])
    return pairs.mapInArrow(run, schema)
