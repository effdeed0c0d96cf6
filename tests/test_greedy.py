"""Rounds against the sequential definitions on random boxes with ties, and fixed cases."""

import random

import pytest

from skyfuse.operators import evaluate as ev
from skyfuse.operators import fusion
from skyfuse.operators.components import components
from skyfuse.operators.greedy import greedy_matching

F = "seq long, score double, x1 double, y1 double, x2 double, y2 double, src string, con_sem double, con_pv double, con_weight double"


def boxes(seed, n=60, side=12):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        s = rng.randrange(1, 6) / 8
        out.append((k, s, float(x), float(y), float(x + rng.randrange(1, 5)), float(y + rng.randrange(1, 5)), f"i{k % 4}", s, s / 2, s))
    return out


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / (area(a) + area(b) - w * h)


def smaller(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / min(area(a), area(b)) if w > 0 and h > 0 else 0.0


def scan(rows, over, thr):
    kept, head = [], {}
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        h = next((k for k in kept if over(k, r) > thr), None)
        head[r[0]] = r[0] if h is None else h[0]
        if h is None:
            kept.append(r)
    return head


@pytest.mark.parametrize("seed", [1, 2])
def test_selection(spark, seed):
    rows = boxes(seed)
    d = spark.createDataFrame(rows, F).repartition(3)
    head = scan(rows, iou, 0.2)
    assert {r.seq for r in fusion.suppressed(d, 0.2).collect()} == {k for k, h in head.items() if k == h}
    by = {s: scan([r for r in rows if r[6] == s], iou, 0.2) for s in {r[6] for r in rows}}
    assert {r.seq for r in fusion.suppressed(d, 0.2, ["src"]).collect()} == {k for h in by.values() for k, v in h.items() if k == v}
    c = {r["head"]: r for r in fusion.clusters(d, 0.2).collect()}
    assert set(c) == set(head.values())
    for h, r in c.items():
        m = [x for x in rows if head[x[0]] == h]
        assert r.n == len(m) and r.src == ";".join(sorted({x[6] for x in m}))
        assert r.con_sem == pytest.approx(sum(x[7] * x[1] for x in m) / sum(x[1] for x in m))
    merged = scan(rows, smaller, 0.5)
    g = {r["head"]: r for r in fusion.merged_groups(d, 0.5).collect()}
    assert {h: r.n for h, r in g.items()} == {h: list(merged.values()).count(h) for h in set(merged.values())}


@pytest.mark.parametrize("seed", [3])
def test_matching(spark, seed):
    preds, gts = boxes(seed, 40), [(*r[:1], r[2], r[3], r[4], r[5]) for r in boxes(seed + 10, 25)]
    p = spark.createDataFrame(preds, F)
    g = spark.createDataFrame(gts, "gt long, x1 double, y1 double, x2 double, y2 double")
    pairs = ev.overlap_pairs(p, g).checkpoint()
    box = {r[0]: (0, 0, *r[1:]) for r in gts}
    for thr in (0.3, 0.5):
        free, want = set(box), set()
        for r in sorted(preds, key=lambda r: (-r[1], r[0])):
            best = max(((iou(r, box[k]), k) for k in free), default=(0, None))
            if best[1] is not None and best[0] >= thr and best[0] > 0:
                free.discard(best[1])
                want.add((r[0], best[1]))
        assert {(r.seq, r.gt) for r in ev.matched(pairs, (thr,)).collect()} == want
    free, want = {r[0]: r for r in preds}, set()
    for k in sorted(box):
        best = min(((-iou(r, box[k]), i) for i, r in free.items()), default=(0, None))
        if best[0] < 0:
            want.add((k, best[1]))
            del free[best[1]]
    assert {(r.gt, r.seq) for r in ev.aji_matches(pairs).collect()} == want


def test_empty_edges(spark):
    e = spark.createDataFrame([], "a long, b long, o long")
    assert greedy_matching(e, ["a"], ["b"], ["o", "a", "b"]).count() == 0
    assert components(e.select("a", "b")).count() == 0


@pytest.mark.parametrize("strategy", ["prefer", "confidence", "union"])
@pytest.mark.parametrize("seed", [4])
def test_merge(spark, strategy, seed):
    image = [r for r in boxes(seed, 40) if scan(boxes(seed, 40), iou, 0.2)[r[0]] == r[0]]
    ortho = boxes(seed + 7, 30)
    merged = [("image", r[0], "kept", r) for r in image]
    for r in ortho:
        best, top = -1, -1.0
        for k, m in enumerate(merged):
            if m[3][1] > top and iou(m[3], r) > 0.2:
                best, top = k, m[3][1]
        if best < 0 or strategy == "union":
            merged.append(("ortho", r[0], "added", r))
        elif strategy == "prefer" or r[1] > merged[best][3][1]:
            merged[best] = ("ortho", r[0], "replaced", r)
    got = fusion.merge_sources(spark.createDataFrame(image, F), spark.createDataFrame(ortho, F), strategy, 0.2)
    assert sorted((r.source, r.seq, r.outcome) for r in got.collect()) == sorted(m[:3] for m in merged)


def test_unknown_strategy(spark):
    a = spark.createDataFrame(boxes(1, 3), F)
    with pytest.raises(ValueError):
        fusion.merge_sources(a, a, "newest", 0.2)
    far = a.withColumn("x1", a.x1 + 1000).withColumn("x2", a.x2 + 1000)
    assert fusion.merge_sources(a, far, "newest", 0.2).count() == 6
    with pytest.raises(ValueError):
        fusion.fused(a, "median")


def test_view_sample(spark):
    d = spark.createDataFrame(boxes(5, 80), F)
    g = {r.seq: r.root for r in fusion.view_groups(d, 0.1, 1.5).collect()}
    s = [r.root for r in fusion.view_sample(d, 2, 0.1, 1.5).collect()]
    for root in set(g.values()):
        assert s.count(root) == min(2, list(g.values()).count(root))
