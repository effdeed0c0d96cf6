"""Readers, writers, windows, prompts, reports, configuration, rounds and the stream, on small literal inputs."""

import json
import struct

import numpy as np
import pytest

from skyfuse.functions.camera import Camera
from skyfuse.operators import inference, reports, votes, windows
from skyfuse.operators.ordering import placed
from skyfuse.operators.terrain import Rays, Terrain
from skyfuse.plans import config, detection, sweep
from skyfuse.sources import features, shapefile, tables
from skyfuse.streaming.image_nms import suppress_stream

BOX = "seq long, score double, x1 double, y1 double, x2 double, y2 double"


def test_lists(spark, tmp_path):
    for n in ("b.jpg", "a.jpg"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "list.txt").write_text("# comment\n\nb.jpg\n/abs/c.jpg\n")
    got = tables.image_list(spark, ["b.jpg", "z.jpg"], None, str(tmp_path / "list.txt"), str(tmp_path)).orderBy("no").collect()
    assert [r.value for r in got] == [f"{tmp_path}/b.jpg", f"{tmp_path}/z.jpg", "/abs/c.jpg"]
    assert tables.image_list(spark, pattern=str(tmp_path / "*.jpg")).count() == 2
    with pytest.raises(ValueError):
        tables.image_list(spark)


def test_poses_and_names(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,X,Y,Z,phi,omega,kappa\nA.JPG,1,2,3,0,0,0\nshort,1\na,9,9,9,0,0,0\nA.JPG,4,5,6,0,0,0,extra\n")
    p = tables.poses(spark, str(tmp_path / "p.csv"))
    rows = {r.name: r for r in p.collect()}
    assert rows["A.JPG"].xs == 4 and rows["name"].xs is None and set(rows) == {"name", "A.JPG", "a"}
    f = spark.createDataFrame([("/d/A.JPG",), ("/d/A.TIF",), ("/d/q.tif",)], "path string")
    got = {r.path: r.xs for r in tables.keyed_by_name(f, "path", p).collect()}
    assert got == {"/d/A.JPG": 4.0, "/d/A.TIF": 9.0, "/d/q.tif": None}


def test_prompts_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "img1.txt").write_text("0,0,30,30\n0 0 10 10\nbad,0,1\n1,2,3,x\n")
    b = tables.prompt_boxes(spark, str(tmp_path / "in")).collect()
    assert [tuple(r) for r in b] == [("img1", 0.0, 0.0, 30.0, 30.0)]
    tables.write_prompts(spark.createDataFrame([("a", "1,2,3,4"), ("b", "5,6,7,8")], "src string, value string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    (tmp_path / "r.csv").write_text("﻿station,iter,variant,f1\ns,0,v,0.1\ns,0,v,0.2\n", encoding="utf-8")
    assert [r.f1 for r in tables.result_rows(spark, str(tmp_path / "r.csv")).collect()] == ["0.2"]
    d = spark.createDataFrame([("/x/ours/iter_2/final.shp",), ("/x/iter_1/m1/final.shp",), ("/x/cache/iter_1/a.shp",)], "path string")
    assert {(r.iter, r.variant) for r in tables.result_files(d).collect()} == {(2, "ours"), (1, "m1")}


def test_export(spark):
    d = spark.createDataFrame([(1, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 0.6, None, 0.0, 1.0, 1.0), (3, 0.7, 0.0, 0.0, 2.0, 2.0)], BOX)
    got = features.exported(d).collect()
    assert [r.id for r in got] == [1, 3] and len(got[0].asDict()) == len(features.EXPORT) + 1  # gaps where nothing can be drawn


def test_shapefile(spark, tmp_path):
    rings = [[[0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]], [[5.0, 5.0, 6.0, 5.0, 6.0, 6.0, 5.0, 5.0], [5.1, 5.1, 5.2, 5.1, 5.2, 5.2, 5.1, 5.1]]]
    (tmp_path / "a.shp").write_bytes(shapefile.write_shapes(rings))
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, 2, 32 + 32 + 1, 6) + struct.pack("<11sc4xBB14x", b"src", b"C", 5, 0) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" im1  " + b" im2  ")
    spark.dataSource.register(shapefile.Shapefile)
    got = spark.read.format("polygons").option("paths", str(tmp_path / "a.shp")).load().orderBy("seq_in_file").collect()
    assert [r.seg for r in got] == rings and [r["fields"]["src"] for r in got] == ["im1", "im2"]


def test_windows_and_prompts(spark):
    img = spark.createDataFrame([(1, 2500, 1000), (2, 1024, 1024)], "img long, width int, height int")
    w = windows.windows(img)
    assert [(r.x, r.y, r.w, r.h) for r in w.where("img = 1").orderBy("no").collect()] == [(0, 0, 1024, 1000), (512, 0, 1024, 1000), (1024, 0, 1024, 1000), (1476, 0, 1024, 1000)]
    assert w.where("img = 2").count() == 1
    boxes = spark.createDataFrame([(k, 1, 100.0 + k, 10.0, 140.0 + k, 50.0) for k in range(6)], "box long, img long, x1 double, y1 double, x2 double, y2 double")
    p = windows.window_prompts(w, boxes, 3)
    assert p.count() == 3 and windows.window_prompts(w, boxes, 0).count() == 6
    assert windows.windows_with_prompts(w, p).count() == 1
    from pyspark.sql import functions as F

    lists = w.where("no = 0").withColumn("prompts", F.array(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])))
    got = inference.predicted(lists.withColumn("x", F.lit(10)).withColumn("y", F.lit(20))).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got] == [(11.0, 22.0, 13.0, 24.0)] * 2
    with pytest.raises(ValueError):
        inference.model("nothing")
    assert inference.mask_ring(np.array([[0, 0, 0], [0, 1, 1], [0, 0, 1]])) == [1, 1, 3, 1, 3, 3, 2, 3, 2, 2, 1, 2]
    assert inference.mask_ring(np.zeros((2, 2))) is None


def test_votes(spark):
    side = [(k, 1.0, 2.0 * (k % 14), 2.0 * (k // 14), 2.0 * (k % 14) + 1, 2.0 * (k // 14) + 1) for k in range(196)]
    far = [(999, 1.0, 295000.0, 0.0, 295001.0, 1.0)]
    d = spark.createDataFrame(side + far, BOX)
    assert votes.robust_bounds(d) == (0.0, 0.0, 27.0, 27.0)
    assert votes.robust_bounds(d, 0)[2] == 295001.0
    assert votes.robust_bounds(spark.createDataFrame(side[:5] + far, BOX))[2] == 295001.0
    assert votes.robust_bounds(spark.createDataFrame([], BOX)) is None
    got = votes.pixel_vote(d, 0.5, 1, min_area=0.5)
    assert got.count() == 196 and {r.area for r in got.select("area").collect()} == {1.0}
    with pytest.raises(ValueError):
        votes.grid_of((0, 0, 1e6, 1e6), 0.1, strict=True)
    g = votes.grid_of((0, 0, 1e6, 1e6), 0.1)
    assert g.width * g.height < 4.1e8
    truth = spark.createDataFrame([(k, *b[2:]) for k, b in enumerate(side)], "gt long, x1 double, y1 double, x2 double, y2 double")
    s = sweep.sweep(d, truth, (0.5,), (1,), (0.0, 5.0)).collect()
    assert [(r.n_pred, r.f1) for r in s] == [(196, 1.0), (0, 0.0)]
    # squares 2 km apart: the cells of a wide site are as small as told
    wide = spark.createDataFrame([(k, 1.0, 1000 * b[2], 1000 * b[3], 1000 * b[2] + 1, 1000 * b[3] + 1) for k, b in enumerate(side)], BOX)
    got = votes.pixel_vote(wide, 0.5, 1)
    assert got.count() == 196 and {(r.cells, r.area) for r in got.select("cells", "area").collect()} == {(4, 1.0)}
    diagonal = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (3, 3, 1.0)], "r long, c long, votes double")
    assert sorted(r.cells for r in votes.instances(diagonal, votes.Grid(0, 10, 10, 10, 1.0), 1).collect()) == [1, 1, 2]


def test_places(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skyfuse.operators import ordering

    d = spark.createDataFrame([((k * 37) % 1000, k) for k in range(1000)], "v long, k long").repartition(5)
    for bound in (10_000, 100):
        monkeypatch.setattr(ordering, "ONE_TASK", bound)
        assert all(r.place == r.v + 1 for r in placed(d, [F.asc("v")]).collect())


def test_reports(spark):
    s = spark.createDataFrame([("a", k, k % 2, 2, float(k), 1) for k in range(5)], "key string, finished long, worker int, world int, minutes double, calls int")
    r = reports.run_costs(s, ["key"]).first()
    assert (r.calls, r.wall_minutes, r.invocations, r.world) == (5, 1.0 + 3.0 + 4.0, 3, 2)
    c = lambda f, n: spark.createDataFrame([(f, n)], "f1 double, n_pred long")
    assert reports.converged(c(0.9, 1000), c(0.903, 1005)).first()[0] and not reports.converged(c(0.9, 1000), c(0.91, 1000)).first()[0]
    assert "| -- |" in reports.text_table(spark.createDataFrame([("x", None)], "a string, b string"))


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"fusion": {"iou": 0.3, "merge": True}, "prior": {"length": 2.0}}))
    (tmp_path / "site.json").write_text(json.dumps({"_base_": "base.json", "fusion": {"iou": 0.25}}))
    c = config.build(config.override(config.load(str(tmp_path / "site.json")), ["rays.seed=3", "fusion.strategy=prefer"]))
    assert (c.fusion.iou, c.fusion.merge, c.prior.length, c.rays.seed, c.fusion.strategy) == (0.25, True, 2.0, 3, "prefer")
    with pytest.raises(ValueError):
        config.build({"fusion": {"nothing": 1}})
    assert config.first_crs(None, "", "EPSG:1") == "EPSG:1" and detection.view_counts("1-3,20,all") == [1, 2, 3, 20, None]


def test_round(spark):
    """Two photos and an orthophoto of the same panel: one feature is left, and prompts come for both kinds."""
    cam = Camera(focal=100, cx=50, cy=50, width=100, height=100, mean_height=5.0)
    pose = (0.0, 0.0, 55.0, 0.0, 0.0, 0.0)
    images = spark.createDataFrame([("o", [-50.0, 0.5, 0.0, 50.0, 0.0, -0.5], *([None] * 6), 200, 200), ("p1", None, *pose, 100, 100), ("p2", None, *pose, 100, 100)], "src string, geotransform array<double>, xs double, ys double, zs double, phi double, omega double, kappa double, width int, height int")
    ring = lambda x1, y1, x2, y2: [[float(v) for v in (x1, y1, x2, y1, x2, y2, x1, y2)]]
    raw = spark.createDataFrame([(1, "p1", ring(46, 48, 54, 52), 0.9, 900.0), (2, "p2", ring(46, 48, 54, 52), 0.8, 900.0), (3, "o", ring(96, 98, 104, 102), 0.7, 900.0), (4, "o", ring(96, 98, 104, 102), 0.1, 900.0), (5, "p1", ring(46, 48, 54, 52), 0.9, 10.0)], "seq long, src string, seg array<array<double>>, score double, pixel_area double")
    cfg = config.build({"prior": {"length": 4.0, "width": 2.0}, "score_threshold": 0.2, "projection": "collinearity", "prompts": {"min_size": 1.0}})
    cfg = config.replace(cfg, camera=cam, rays=Rays(tolerance=1e-6))
    ground = Terrain.of(np.full((200, 200), 5.0), (-50, 0.5, 0, 50, 0, -0.5))
    r = detection.run_round(raw, images, ground, cfg)
    assert r.features.count() == 3 and r.fused.count() == 1
    one = r.fused.first()
    assert one.seq == 1 and np.allclose((one.x1, one.y1, one.x2, one.y2), (-2, -1, 2, 1), atol=0.01)
    assert r.prompts["ortho"].count() == 1 and {x.src for x in r.prompts["oblique"].collect()} == {"p1", "p2"}
    assert [c[0] for c in r.counts] == ["features", "image-nms", "views", "fusion"]
    rows = detection.iterate(r, lambda p: r, lambda f: f.selectExpr("0.5D as f1", "1L as n_pred").limit(1))
    assert len(rows) == 2
    pre = {x.what: x.n for x in detection.preflight(images.select("src"), images.where("src <> 'p2'").select("src")).collect()}
    assert pre == {"image without pose": 1, "pose without image": 0, "repeated image": 0}

    # every method ends, with a second source; features of unlisted images are told, not lost in silence
    more = raw.unionByName(spark.createDataFrame([(6, "p9", ring(46, 48, 54, 52), 0.9, 900.0)], raw.schema))
    ortho = spark.createDataFrame([(1, 0.95, -2.0, -1.0, 2.0, 1.0)], "seq long, score double, x1 double, y1 double, x2 double, y2 double")
    for method in ("cluster_weighted", "pixel_vote"):
        c = config.replace(cfg, fusion=config.replace(cfg.fusion, method=method, merge=True))
        m = detection.run_round(more, images, ground, c, ortho)
        one = m.fused.first()
        assert m.fused.count() == 1 and np.allclose((one.x1, one.y1, one.x2, one.y2), (-2, -1, 2, 1), atol=0.25)
        assert ("image-not-listed", 1, 0) in m.counts
        assert {x.src for x in m.prompts["oblique"].collect()} == {"p1", "p2"} and m.prompts["ortho"].count() == 1


def test_prompt_corners(spark):
    """Corners of the smallest rectangle, each at the height of the ground under it; the mean height off the grid."""
    ramp = np.tile(np.arange(100, dtype=float), (100, 1))  # height = column
    ground = Terrain.of(ramp, (0.0, 1.0, 0.0, 100.0, 0.0, -1.0))
    turned = [10.0, 10.0, 14.0, 13.0, 11.0, 17.0, 7.0, 14.0]  # 5 x 5 at an angle
    f = spark.createDataFrame([(1, [turned], 7.0, 10.0, 14.0, 17.0), (2, None, 500.0, 500.0, 501.0, 502.0)], "seq long, seg array<array<double>>, x1 double, y1 double, x2 double, y2 double")
    got = {r.seq: r for r in detection.prompt_corners(f, 42.0, ground).collect()}
    corners = {(round(got[1][f"gx{k}"], 6), round(got[1][f"gy{k}"], 6)) for k in range(4)}
    assert corners == {(10.0, 10.0), (14.0, 13.0), (11.0, 17.0), (7.0, 14.0)}
    for k in range(4):
        assert abs(got[1][f"gz{k}"] - got[1][f"gx{k}"]) <= 1.0 and got[2][f"gz{k}"] == 42.0


def test_log_folders(spark):
    from pyspark.sql import functions as F

    paths = {"iter_0/full/logs": (0, "full"), "iter_0/shared/logs": (0, "shared"), "iter_2/dirs/O1/logs": (2, "O1"), "ours/iter_1/logs": (1, "ours"), "ours/iter_1/dom/logs": (1, "ours"), "iter_0/logs": None, "iter_0/full/x/logs": None, "iter_1/iter_2/logs": None, "figures/logs": None, "a/b/iter_1/logs": None, "ours/iter_1/tdom/logs": None}
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.key and tuple(r.key) for r in d.select("path", reports.log_key(F.col("path")).alias("key")).collect()} == paths


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 0.9, 0.0, 0.0, 2.0, 2.0), (2, "a", 0.8, 0.1, 0.0, 2.1, 2.0), (3, "b", 0.8, 0.1, 0.0, 2.1, 2.0)], "seq long, src string, score double, x1 double, y1 double, x2 double, y2 double")
    d.write.parquet(str(tmp_path / "in"))
    q = suppress_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "seq long, src string, score double, x1 double, y1 double, x2 double, y2 double")
    q.awaitTermination(120)
    assert {r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}
