"""Polygon and terrain kernels on shapes with known answers; random polygons against the JTS of Spark's own jars."""

import math
import random

import numpy as np
import pytest

from skyfuse.functions import polygons as pg
from skyfuse.functions.camera import Camera
from skyfuse.operators import terrain as tr

SQUARE = lambda x, y, s: [[x, y, x + s, y, x + s, y + s, x, y + s]]
BOW = [[0, 0, 2, 2, 2, 0, 0, 2, 0, 0]]


def test_areas():
    assert pg.polygon_area(SQUARE(0, 0, 2)) == 4
    assert pg.polygon_area(SQUARE(0, 0, 4) + SQUARE(1, 1, 1)) == 15
    assert pg.polygon_area([[0, 0, 1, 1]]) == 0 and pg.polygon_area(None) == 0
    assert pg.union_area([BOW]) == pytest.approx(1.0)
    assert pg.union_area([BOW, SQUARE(10, 10, 2), None, [[0, 0]]]) == pytest.approx(5.0)
    assert pg.intersection_area(SQUARE(0, 0, 2), SQUARE(1, 0, 2)) == pytest.approx(2)
    assert pg.intersection_area(SQUARE(0, 0, 4) + SQUARE(1, 1, 2), SQUARE(1, 1, 2)) == pytest.approx(0)


def test_overlap_falls_back_to_boxes():
    assert pg.pair_overlap(SQUARE(0, 0, 2), (0, 0, 2, 2), SQUARE(1, 0, 2), (1, 0, 3, 2))[0] == pytest.approx(1 / 3)
    assert pg.pair_overlap(None, (0, 0, 2, 2), SQUARE(1, 0, 2), (1, 0, 3, 2)) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 0.0)


def test_smallest_rectangle():
    w, h, area, corners = pg.smallest_rectangle([0, 0, 3, 3, 2, 4, -1, 1])
    assert sorted((w, h)) == pytest.approx([math.sqrt(2), 3 * math.sqrt(2)]) and area == pytest.approx(6)
    assert pg.shoelace(corners) == pytest.approx(6) and pg.smallest_rectangle([0, 0, 1, 1])[2] == 0


def test_against_jts(spark):
    jvm = spark._jvm
    reader = jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(8)

    def star(cx, cy):
        n = rng.randrange(3, 9)
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        return [[v for t in at for r in [rng.uniform(0.5, 3)] for v in (cx + r * math.cos(t), cy + r * math.sin(t))]]

    def jts(seg):
        p = np.array(seg[0]).reshape(-1, 2).tolist()
        return reader.read("POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in [*p, p[0]]) + "))")

    done = 0
    for _ in range(60):
        a, b = star(0, 0), star(1, 0.5)
        ja, jb = jts(a), jts(b)
        if not (ja.isValid() and jb.isValid()):
            continue
        done += 1
        assert pg.intersection_area(a, b) == pytest.approx(ja.intersection(jb).getArea(), abs=1e-9)
        assert pg.union_area([a, b]) == pytest.approx(ja.union(jb).getArea(), abs=1e-9)
        assert pg.polygon_area(a) == pytest.approx(ja.getArea())
    assert done > 20


def two_levels():
    h = np.full((120, 120), 10.0)
    h[58:] = 12.0
    return tr.Terrain.of(h, (0, 1, 0, 100, 0, -1))


def test_nearest_hit():
    p = tr.Projector(two_levels(), Camera(focal=100, cx=0, cy=0, width=200, height=200), tr.Rays(tolerance=0.01))
    pose = (50.0, 0.0, 40.0, 0.0, 0.6, 0.0)
    hit = p.hits([[0.0, -10.0]], pose)[0]
    assert hit[2] in (10.0, 12.0) and np.isfinite(hit).all()
    flat = tr.Projector(tr.Terrain.of(np.full((120, 120), 10.0), (0, 1, 0, 100, 0, -1)), p.cam, p.rays)
    h = flat.hits([[0.0, -10.0]], pose)[0]
    assert h[2] == 10.0 and h[:2] == pytest.approx(flat.at_height([[0.0, -10.0]], pose, 10.0)[0], abs=0.05)
    assert np.isnan(flat.hits([[0.0, 1e6]], (5000.0, 0, 40.0, 0, 0, 0))).all()


def test_rotation_identity():
    assert (tr.rotation(0, 0, 0) == np.eye(3)).all()


def test_sawtooth_plane():
    """Two parallel rows; the anchor decides which one is fitted."""
    y, x = np.mgrid[0:200, 0:60] * 0.05
    row = np.where(y < 5, 0.1, 4.9)
    z = 38 + 0.3 * (y - row)
    p = tr.Projector(None, Camera(), tr.Rays())
    for at in (2.0, 7.0):
        anchor = (1.5, at, 38 + 0.3 * (at - (0.1 if at < 5 else 4.9)))
        a, b, c, n, rmse = p.plane(x.ravel(), y.ravel(), z.ravel(), anchor)
        assert math.degrees(math.atan(math.hypot(a, b))) == pytest.approx(16.7, abs=0.3)
        assert abs(a * anchor[0] + b * anchor[1] + c - anchor[2]) < 0.2
        assert p.plane(x.ravel(), y.ravel(), z.ravel(), anchor) == (a, b, c, n, rmse)
    assert p.plane(x.ravel()[:3], y.ravel()[:3], z.ravel()[:3]) is None


def test_methods_and_failures(spark):
    cam = Camera(focal=100, cx=50, cy=50, width=100, height=100)
    p = tr.Projector(tr.Terrain.of(np.full((200, 200), 5.0), (-50, 0.5, 0, 50, 0, -0.5)), cam, tr.Rays(search_margin=2.0, tolerance=1e-6))
    seg, box, pose = [[40.0, 40.0, 60.0, 40.0, 60.0, 60.0, 40.0, 60.0]], (40, 40, 60, 60), (0.0, 0.0, 55.0, 0.0, 0.0, 0.0)
    want = [[-5, 5, 5, 5, 5, -5, -5, -5]]
    for m in ("affine", "collinearity", "slope", "auto"):
        got = p.feature(seg, box, pose, m)
        assert got["method"] == {"auto": "affine"}.get(m, m)
        assert np.allclose(got["seg"], want, atol=0.05)
    assert p.feature(seg, box, None)["method"] == "pose_missing_failed"
    away = (5000.0, 0.0, 55.0, 0.0, 0.0, 0.0)
    assert [p.feature(seg, box, away, m)["method"] for m in ("affine", "collinearity", "slope")] == ["affine_failed", "collinearity_failed", "slope_failed"]
    stored = p.t.stored(spark)
    q = tr.Projector(stored, cam, p.rays)
    assert np.allclose(q.feature(seg, box, pose, "collinearity")["seg"], p.feature(seg, box, pose, "collinearity")["seg"])
    d = spark.createDataFrame([(1, seg, *map(float, box), *pose), (2, seg, *map(float, box), *away)], "seq long, seg array<array<double>>, x1 double, y1 double, x2 double, y2 double, xs double, ys double, zs double, phi double, omega double, kappa double")
    assert [r.method for r in tr.projected(d, p.t, cam, p.rays, "affine").orderBy("seq").collect()] == ["affine", "affine_failed"]
    with pytest.raises(ValueError):
        tr.affine_fit([(0, 0)], [(0, 0)])


def test_level_ground_holds_every_image(spark):
    """The rays of images far out land on the ground too."""
    import numpy as np

    from skyfuse.functions.camera import Camera
    from skyfuse.operators import terrain
    from skyfuse.plans.geometry_queries import _ground

    poses = [(0.0, 0.0, 80.0, 0.5, 0.0, 3.0), (108.0, 36000.0, 104.0, 0.5, 0.0, -3.0), (-5000.0, 90.0, 104.0, 0.0, 0.0, 0.0)]
    ground = _ground(images=spark.createDataFrame([p[:3] for p in poses], "xs double, ys double, zs double"))
    proj, cam = terrain.Projector(ground, Camera(), terrain.Rays(tolerance=1e-7)), Camera()
    pix = [[cam.cx + 200.0, cam.cy + 150.0]]
    for p in poses:
        assert np.allclose(proj.hits(pix, p)[0], [*proj.at_height(pix, p, 10.0)[0], 10.0], atol=1e-6)
    assert _ground(images=spark.createDataFrame([], "xs double, ys double, zs double")).geo == _ground().geo
