"""Operators on polygons against scans over the slab kernel's overlaps, and on edge cases of rings."""

import math
import random

import numpy as np
import pytest

from skyfuse.functions import polygons as pg
from skyfuse.operators import evaluate as ev
from skyfuse.operators import fusion, votes
from skyfuse.operators.areas import scene_areas
from skyfuse.operators.components import components

F = "seq long, score double, x1 double, y1 double, x2 double, y2 double, src string, con_sem double, con_pv double, con_weight double, seg array<array<double>>"


def panel(rng, x, y, angle):
    w, h = rng.uniform(1, 3), rng.uniform(0.6, 1.5)
    c, s = math.cos(angle), math.sin(angle)
    return [v for a, b in ((-w, -h), (w, -h), (w, h), (-w, h)) for v in (x + a / 2 * c - b / 2 * s, y + a / 2 * s + b / 2 * c)]


def star(rng, x, y, n=7):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [v for a in at for r in [rng.uniform(0.4, 1.4)] for v in (x + r * math.cos(a), y + r * math.sin(a))]


def features(seed, n=36, side=7):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.uniform(0, side), rng.uniform(0, side)
        kind = k % 6
        seg = [panel(rng, x, y, rng.uniform(0, 3))] if kind < 3 else [star(rng, x, y)] if kind < 5 else [panel(rng, x, y, 0.0)]
        if k % 12 == 0:  # a panel
            seg.append([x, y, x + 0.2, y, x, y + 0.2])  # a hole
        if k % 13 == 0:
            seg = [[x - 1, y - 1, x + 1, y + 1, x + 1, y - 1, x - 1, y + 0.8]]  # crosses itself
        xs, ys = seg[0][0::2], seg[0][1::2]
        if k % 17 == 0:
            seg = None if k % 2 else [[x, y, x + 1, y]]  # no ring, no area: counts by its box
        s = rng.randrange(1, 9) / 8
        out.append((k, s, min(xs), min(ys), max(xs), max(ys), f"i{k % 4}", s, s / 2, s, seg))
    return out


def over(a, b, k=0):
    if pg.bbox_iou(a[2:6], b[2:6]) == 0:
        return 0.0
    return pg.pair_overlap(a[10], a[2:6], b[10], b[2:6])[k]


def scan(rows, thr, k=0):
    kept, head = [], {}
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        h = next((q for q in kept if over(q, r, k) > thr), None)
        head[r[0]] = r[0] if h is None else h[0]
        kept += [r] if h is None else []
    return head


@pytest.mark.parametrize("seed", [1])
def test_selection_by_polygons(spark, seed):
    rows = features(seed)
    d = spark.createDataFrame(rows, F).repartition(3)
    head = scan(rows, 0.2)
    assert {r.seq for r in fusion.suppressed(d, 0.2).collect()} == {k for k, h in head.items() if k == h}
    c = {r["head"]: r for r in fusion.clusters(d, 0.2).collect()}
    assert {h: r.n for h, r in c.items()} == {h: list(head.values()).count(h) for h in set(head.values())}
    assert all(r["seg"] == rows[h][10] and r["seq"] == h and r["x1"] == rows[h][2] for h, r in c.items())
    small = scan(rows, 0.5, 1)
    assert {r["head"]: r.n for r in fusion.merged_groups(d, 0.5).collect()} == {h: list(small.values()).count(h) for h in set(small.values())}
    roots = {r.seq: r.root for r in fusion.view_groups(d, 0.1).collect()}
    want = {r[0]: r[0] for r in rows}
    near = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and pg.bbox_iou(a[2:6], b[2:6]) > 0 and over(a, b) > 0.1]
    for _ in rows:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert roots == want


@pytest.mark.parametrize("what", ["suppressed", "merged_groups", "clusters"])
def test_blocks_and_passes(spark, monkeypatch, what):
    """Rows go through small blocks in passes, with no edges or pairs written, and come to what a scan of all does."""
    rows = features(3, 150, 16)
    rows[7] = (*rows[7][:2], None, *rows[7][3:])  # overlaps nothing
    small, wrote = what == "merged_groups", []
    monkeypatch.setattr(fusion, "PASS", 60)
    monkeypatch.setattr(fusion, "_block_side", lambda f, tile: (f.count(), 2))
    write = fusion.materialize

    def seen(df, name):
        wrote.append((name, df.columns))
        return write(df, name)

    monkeypatch.setattr(fusion, "materialize", seen)
    d = spark.createDataFrame(rows, F)
    got = getattr(fusion, what)(d, 0.5 if small else 0.2).collect()
    head = scan([r for r in rows if r[0] != 7], 0.5 if small else 0.2, int(small)) | {7: 7}
    if what == "suppressed":
        assert sorted((r.seq, r.score, r.seg) for r in got) == sorted((k, rows[k][1], rows[k][10]) for k, h in head.items() if k == h)
    else:
        assert {r["head"]: r.n for r in got} == {h: list(head.values()).count(h) for h in set(head.values())}
    assert sum(n == "scan-live" for n, _ in wrote) >= 3
    assert not [n for n, c in wrote if "edge" in c and n != "nms-rows"]


def test_arrow_edges():
    """As ring by ring, in columns: turns of a box, repeated ends, holes, crossings, no ring, nulls."""
    import pyarrow as pa

    segs = [f[10] for f in features(2, 60)] + [[[0.0, 0, 2, 0, 2, 1, 0, 1]], [[2.0, 1, 0, 1, 0, 0, 2, 0, 2, 1]], [[0.0, 0, 2, 1, 2, 0, 0, 1]], [], None]
    box = np.array([(0.0, 0.0, 2.0, 1.0)] * len(segs))
    for these in (segs, [*segs[:-1], [None]]):
        sizes, edge, area, plain = pg.arrow_edges(pa.array(these, pa.list_(pa.list_(pa.float64()))), box)
        at = 0
        for seg, n, a in zip(these, sizes, area, strict=True):
            want = pg.signed_edges(seg)
            assert n in (0, len(want or ()))
            assert not n or np.allclose(sorted(edge[at : at + n].tolist()), sorted(want), atol=1e-12)
            assert abs(a - (pg.polygon_area(seg) if want else 0.0)) < 1e-9
            at += n
        assert np.flatnonzero(plain).tolist() == [60, 61]


def test_a_cluster_meets_its_first_not_itself(spark, monkeypatch):
    """Views of far panels at an angle: each passes the kernel once for each row kept near it, not for every view."""
    rng, rows, seen = random.Random(5), [], []
    for k in range(200):
        ring = panel(rng, 10.0 * (k % 5), 0.0, 0.6)
        s = rng.random()
        rows.append((k, s, min(ring[0::2]), min(ring[1::2]), max(ring[0::2]), max(ring[1::2]), "i", s, s, s, [ring]))
    kernel = fusion.shape_overlaps

    def counted(pairs):
        seen.append(pairs.count())
        return kernel(pairs)

    monkeypatch.setattr(fusion, "shape_overlaps", counted)
    d = spark.createDataFrame(rows, F)
    got = {r.seq for r in fusion.suppressed(d, 0.2).collect()}
    assert got == {k for k, h in scan(rows, 0.2).items() if k == h}
    assert sum(seen) < 1000  # all pairs: 5 * 40 * 39 / 2 = 3900


def test_parallel_diagonal_panels_stay(spark):
    """Envelopes overlap, polygons don't."""
    ring = lambda dx: [dx, 0.0, dx + 4, 4.0, dx + 3.5, 4.5, dx - 0.5, 0.5]
    rows = [(k, 0.9 - k / 10, d - 0.5, 0.0, d + 4, 4.5, "a", 0.5, 0.5, 0.5, [ring(d)]) for k, d in enumerate((0.0, 1.5))]
    assert fusion.suppressed(spark.createDataFrame(rows, F), 0.2).count() == 2
    assert fusion.suppressed(spark.createDataFrame(rows, F).drop("seg"), 0.2).count() == 1


def test_matching_and_areas_by_polygons(spark):
    preds, gts = features(3, 40), features(4, 25)
    p, g = spark.createDataFrame(preds, F), spark.createDataFrame(gts, F).withColumnRenamed("seq", "gt")
    pairs = {(r.seq, r.gt): r for r in ev.overlap_pairs(p, g).collect()}
    for a in preds:
        for b in gts:
            v = over(a, b)
            assert (v < 1e-12 and pairs.get((a[0], b[0])) is None) or abs(pairs[a[0], b[0]].iou - v) < 1e-9
    area = {r.seq: r.a for r in ev.feature_area(p, ("seq",)).collect()}
    for r in preds:
        a = pg.polygon_area(r[10]) if r[10] else 0.0
        assert area[r[0]] == pytest.approx(a if a > 0 else (r[4] - r[2]) * (r[5] - r[3]), abs=1e-9)
    got = scene_areas(p, g, 2.5).first()
    e = [pg.indicator_edges([r[10] for r in rows]) for rows in (preds, gts)]
    want = pg.covered_areas(e[0], e[1], (-5.0, -5.0, 20.0, 20.0))
    assert (got.pred_area, got.gt_area, got.common) == pytest.approx(want, abs=1e-6)
    union = pg.union_area([r[10] for r in preds if r[10]])
    assert got.pred_area == pytest.approx(union, abs=1e-6)
    u = fusion.union_areas(p.where("seg is not null").selectExpr("1L as one", "seg"), "one").first()
    assert u.area == pytest.approx(union, abs=1e-6)


def test_votes_by_polygons(spark):
    rows = features(5, 30)
    g = votes.Grid(-3.03, 14.02, 70, 70, 0.25)
    got = {(r.r, r.c): r.votes for r in votes.cell_votes(spark.createDataFrame(rows, F), g).collect()}
    want = {}
    for r in rows:
        e = pg.signed_edges(r[10]) if r[10] else None
        for i in range(70):
            for j in range(70):
                x, y = -3.03 + (j + 0.5) * 0.25, 14.02 - (i + 0.5) * 0.25
                if not (r[2] <= x < r[4] and r[3] <= y < r[5]):
                    continue
                inside = True if e is None else sum(s for x1, y1, x2, y2, s in e if x1 <= x < x2 and y < y1 + (x - x1) * (y2 - y1) / (x2 - x1)) > 0.5
                if inside:
                    want[i, j] = want.get((i, j), 0) + 1
    assert got == want


def test_signed_edges():
    rng = random.Random(9)
    for k in range(100):
        a = [star(rng, 0, 0, rng.randrange(3, 9))] if k % 3 else [panel(rng, 0, 0, rng.uniform(0, 6))]
        b = [star(rng, rng.uniform(-1, 1), 0.3, 6)] if k % 4 else [[rng.uniform(-1, 1) for _ in range(10)]]
        if k % 5 == 0:
            a.append([0.05, 0.05, 0.2, 0.05, 0.1, 0.2])
        if k % 2:
            a[0] = [v for p in np.array(a[0]).reshape(-1, 2)[::-1].tolist() for v in p]
        one, two = (pg.many_signed_edges([v])[0] for v in (a, b))
        if one is None or two is None:
            continue
        ea, eb = ((np.array([len(e)]), e) for e in (one, two))
        assert pg.common_areas(ea, eb, np.array([-9.0]))[0] == pytest.approx(pg.intersection_area(a, b), abs=1e-9)
    none = (np.zeros(0, np.int64), np.zeros((0, 5)))
    assert len(pg.common_areas(none, none, np.zeros(0))) == 0
    assert pg.many_signed_edges([None, [], [[0.0, 0.0, 1.0, 1.0]], [None], [[0.0, 0.0, 1.0, float("nan"), 2.0, 0.0]]]) == [None] * 5


@pytest.mark.parametrize("strategy", ["prefer", "confidence"])
def test_merge_by_polygons(spark, strategy):
    image, ortho = (features(k, 45) for k in (6, 7))
    image = [r for r in image if scan(image, 0.2)[r[0]] == r[0]]
    merged = [("image", r[0], "kept", r) for r in image]
    for r in ortho:
        best, top = -1, -1.0
        for k, m in enumerate(merged):
            if m[3][1] > top and over(m[3], r) > 0.2:
                best, top = k, m[3][1]
        if best < 0:
            merged.append(("ortho", r[0], "added", r))
        elif strategy == "prefer" or r[1] > merged[best][3][1]:
            merged[best] = ("ortho", r[0], "replaced", r)
    got = fusion.merge_sources(spark.createDataFrame(image, F), spark.createDataFrame(ortho, F), strategy, 0.2)
    assert sorted((r.source, r.seq, r.outcome) for r in got.collect()) == sorted(m[:3] for m in merged)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    """Rounds and the one task for few edges, on chains, stars, loops and repeats."""
    from skyfuse.operators import components as cc

    monkeypatch.setattr(cc, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (300, 301), (301, 300)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {x for x in root if not any(x in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {k: v for k, v in root.items() if k not in alone} and len(got) == len(root) - len(alone)


def test_quantiles(spark):
    from skyfuse.operators.ordering import quantiles

    v = [3.0, 1.5, 9.0, 9.0, -2.0, 7.25, 0.0]
    got = quantiles(spark.createDataFrame([(x,) for x in v], "v double"), "v", (0.0, 0.25, 0.5, 0.75, 1.0), len(v))
    assert got == pytest.approx(np.quantile(v, (0.0, 0.25, 0.5, 0.75, 1.0)).tolist())


def test_pairs_in_passes(spark, monkeypatch):
    """Few predictions a pass: the same pairs and best of each ground truth as in one join."""
    preds, gts = features(7, 30), features(8, 20)
    p, g = spark.createDataFrame(preds, F).coalesce(1), spark.createDataFrame(gts, F).withColumnRenamed("seq", "gt").coalesce(1)
    rows = lambda d: sorted(map(tuple, d.collect()))
    pairs = rows(ev.overlap_pairs(p, g))
    ran, kernel = [], ev.shape_overlaps
    monkeypatch.setattr(ev, "shape_overlaps", lambda d: ran.append(1) or kernel(d))
    monkeypatch.setattr(ev, "PASS", 11)
    assert rows(ev.overlap_pairs(p, g, least=0.1)) == [r for r in pairs if r[3] >= 0.1] and len(ran) == 3
    best = {}
    for r in sorted(pairs, key=lambda r: (-r[3], r[0])):
        if r[3] > 0:
            best.setdefault(r[1], r[0])
    cols = ["seq", "gt", "iou", "inter"]
    got = ev.overlap_pairs(p, g, also=("inter",), each=lambda d: ev._best_of_truth(d.select(*cols), []))
    assert best and {(r.gt, r.seq) for r in ev._best_of_truth(got, []).collect()} == set(best.items())
