"""Metrics on hand-computed scenes."""

import math

import pytest

from skyfuse.operators import evaluate as ev
from skyfuse.operators.areas import scene_areas

P = "seq long, score double, x1 double, y1 double, x2 double, y2 double"
G = "gt long, x1 double, y1 double, x2 double, y2 double"


def scene(spark, preds, gts):
    p = spark.createDataFrame([(k, 1.0, *map(float, r)) for k, r in enumerate(preds)], P)
    g = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(gts)], G)
    return p, g, ev.overlap_pairs(p, g).checkpoint()


@pytest.mark.parametrize(
    ("preds", "gts", "want"),
    [
        ([(0, 0, 2, 1)], [(0, 0, 2, 1)], 1.0),
        ([(0, 0, 1, 1), (1, 0, 2, 1)], [(0, 0, 2, 1)], 1 / 3),
        ([(0, 0, 2, 1)], [(0, 0, 1, 1), (1, 0, 2, 1)], 1 / 3),
        ([(0, 0, 1, 1), (5, 5, 6, 6)], [(0, 0, 1, 1)], 0.5),
        ([], [(0, 0, 1, 1)], 0.0),
        ([(0, 0, 1, 1)], [], 0.0),
    ],
)
def test_aji(spark, preds, gts, want):
    p, g, pairs = scene(spark, preds, gts)
    assert ev.aji(p, g, pairs).first().aji == pytest.approx(want)


def test_strict_thresholds(spark):
    assert len(ev.COCO) == 10 and 0.975 in ev.THRESHOLDS and len(ev.THRESHOLDS) == 11
    p, g, _ = scene(spark, [(0, 0, 9, 10)], [(0, 0, 10, 10)])  # IoU 0.9
    s = ev.summary(p, g).first()
    assert s["map"] == pytest.approx(0.9) and s.ap50 == 1 and s.ap95 == 0 and s.ap_high == pytest.approx(1 / 3)
    assert (s.f1, s.sq, s.pq) == (1.0, pytest.approx(0.9), pytest.approx(0.9))


def test_segmentation_errors(spark):
    one = lambda a, b: tuple(ev.segmentation_errors(scene(spark, a, b)[2]).first())
    assert one([(0, 0, 2, 1)], [(0, 0, 2, 1)]) == (0, 0)
    assert one([(0, 0, 1, 1), (1, 0, 2, 1)], [(0, 0, 2, 1)]) == (1, 0)
    assert one([(0, 0, 2, 1)], [(0, 0, 1, 1), (1, 0, 2, 1)]) == (0, 1)
    assert one([(0, 0, 1, 1), (9, 9, 10, 10)], [(0, 0, 1, 1)]) == (0, 0)


def test_centroids(spark):
    p, g, pairs = scene(spark, [(0.1, 0, 2.1, 1), (0.3, 10, 2.3, 11)], [(0, 0, 2, 1), (0, 10, 2, 11)])
    s = ev.matched_stats(ev.matched(pairs, (0.5,)), p, g).first()
    assert s.centroid_rmse == pytest.approx(math.sqrt((0.01 + 0.09) / 2)) and s.centroid_mae == pytest.approx(0.2)


def test_empty_scenes(spark):
    p, g, pairs = scene(spark, [], [(0, 0, 1, 1)])
    m = ev.matched(pairs, (0.5,))
    c = ev.counts(p, g, m, (0.5,)).first()
    assert (c.tp, c.fp, c.fn, c.f1) == (0, 0, 1, 0.0)
    assert ev.average_precision(p, 1, m, (0.5,)).first().ap == 0.0
    assert ev.average_precision(p, 0, m, (0.5,)).first().ap == 1.0


def test_scene_areas(spark):
    p, g, _ = scene(spark, [(0, 0, 10, 10), (5, 5, 15, 15), (0, 0, 10, 10)], [(8, 8, 20, 20)])
    s = scene_areas(p, g, 7.0).first()
    assert (s.pred_area, s.gt_area, s.common) == (175.0, 144.0, 49.0)
    assert s.iou == pytest.approx(49 / 270) and s.precision == pytest.approx(49 / 175)


def test_first_by_score_needs_no_rounds(spark, monkeypatch):
    """Where no prediction is first at two ground truths, matching and Jaccard write no edges for rounds."""
    monkeypatch.setattr(ev, "greedy_matching", lambda *a: pytest.fail("rounds"))
    rows = [(k * 10 + j, k, 0.5 + 0.01 * j, 0.5 + 0.1 * ((j + k) % 5)) for k in range(4) for j in range(5)]
    pairs = spark.createDataFrame([(s, g, c, i, i, 1.0, 1.0) for s, g, c, i in rows], "seq long, gt long, score double, iou double, inter double, p_area double, g_area double")
    want = {(t, max((c, s) for s, g, c, i in rows if g == k and i >= t)[1], k) for t in (0.5, 0.75, 0.9) for k in range(4) if any(g == k and i >= t for _, g, _, i in rows)}
    assert {(r.thr, r.seq, r.gt) for r in ev.matched(pairs, (0.5, 0.75, 0.9)).collect()} == want
    best = {max((i, -s) for s, g, _, i in rows if g == k)[1] for k in range(4)}
    assert {-r.seq for r in ev.aji_matches(pairs).collect()} == best


def test_joins_collect_no_side(spark):
    """Tables that look small are large once spread over tiles: no broadcast, with boxes larger than a tile too."""
    from pyspark.sql import functions as F

    from skyfuse.operators.tile_join import few_tile_pairs, near_pairs, tile_pairs

    boxes = spark.range(60).select(F.col("id").alias("seq"), (F.col("id") % 7 * 1.5 - 3).alias("x1"), (F.col("id") % 5 * 1.1 - 2).alias("y1"), (F.col("id") % 3 * 2.5 + 0.5).alias("w"))
    boxes = boxes.select("seq", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("w")).alias("y2"))
    near = near_pairs(boxes.select("seq", F.col("x1").alias("x"), F.col("y1").alias("y")), 1.2)
    few = few_tile_pairs(boxes, boxes, 1.0)
    for d in (near, few):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    pairs = lambda d: sorted((r[0], r[1]) for r in d.select("a.seq", "b.seq").collect())
    assert pairs(few) == pairs(tile_pairs(boxes, boxes, 1.0))


def test_votes_travel_as_boxes(spark):
    """Cells of boxes are counted where their block is: one shuffle, below the spreading to cells; right across blocks and edges."""
    from skyfuse.operators import votes

    rows = [(0.25, -3.0, 1.0, 40.0, 2.5), (0.5, 31.0, 30.2, 33.0, 34.0), (0.5, 31.0, 30.2, 33.0, 34.0), (1.0, 90.0, 60.0, 120.0, 64.0)]
    g = votes.Grid(0.0, 64.0, 100, 64, 1.0)
    v = votes.cell_votes(spark.createDataFrame(rows, "score double, x1 double, y1 double, x2 double, y2 double"), g, True)
    plan = v._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [k for k, line in enumerate(plan) if "Exchange" in line]
    assert len(shuffles) == 1 and all(k < shuffles[0] for k, line in enumerate(plan) if "sequence(r0" in line)
    want = {}
    for w, x1, y1, x2, y2 in rows:
        for r in range(64):
            for c in range(100):
                if x1 <= c + 0.5 < x2 and y1 < 64 - r - 0.5 <= y2:
                    want[r, c] = want.get((r, c), 0.0) + w
    assert {(r.r, r.c): r.votes for r in v.collect()} == want
