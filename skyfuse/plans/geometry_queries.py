"""Queries of polygon and terrain kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygons
from ..functions.boxes import box_ring
from ..functions.camera import Camera
from ..operators import fusion, terrain
from ..operators.areas import scene_areas
from ..operators.tile_join import tile_pairs
from . import views
from .fusion_queries import AREA, CLOSED, INTER, IOU, SAME_TILE, tiles
from .registry import query
from .scalar_queries import ROT


def _with_ring(d: DataFrame) -> DataFrame:
    return d.withColumn("seg", F.array(box_ring())).withColumn("box", F.array("x1", "y1", "x2", "y2"))


@query(views.sql("gt", "ortho") + f", {tiles('d', 'ortho')}, {tiles('g', 'gt')} SELECT a.seq, b.gt, round({IOU}, 9) AS iou, round({INTER} / least({AREA.format('a')}, {AREA.format('b')}), 9) AS ios, round({INTER}, 9) AS inter FROM d a JOIN g b ON {SAME_TILE} AND {CLOSED} AND {INTER} > 0")
def g4_polygon_iou(spark: SparkSession, sf: str) -> DataFrame:
    """Exact polygon overlap, after the box test has thrown out what can't meet."""
    p = tile_pairs(_with_ring(views.ortho(spark, sf)), _with_ring(views.truth(spark, sf)), 2.6, None, False)
    p = p.select("a.seq", "b.gt", polygons.overlap_columns(F.col("a.seg"), F.col("a.box"), F.col("b.seg"), F.col("b.box")).alias("o"))
    return p.select("seq", "gt", *[F.round(F.col(f"o.{c}"), 9).alias(c) for c in ("iou", "ios", "inter")])


@query(views.sql("gt") + " SELECT gt, round(2.2e0 * 1.1e0 / 2, 6) AS area, round(least(2.2e0, 2.2e0) * 1.1e0 * 0.8e0, 6) AS rect_area FROM gt".replace("round(least(2.2e0, 2.2e0) * 1.1e0 * 0.8e0, 6)", "round(2.2e0 * 1.1e0 * 0.8e0, 6)"))
def g6_smallest_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    """Rhombs of the boxes' edge middles: half the box, and the smallest rectangle lies along an edge."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    d = views.truth(spark, sf).withColumn("seg", F.array(F.array(mx, "y1", "x2", my, mx, "y2", "x1", my)))
    return d.withColumn("s", polygons.shape_columns(F.col("seg"))).select("gt", F.round("s.area", 6).alias("area"), F.round("s.rect_area", 6).alias("rect_area"))


@query(views.sql("gt") + " SELECT round(2 * count(*) * 2.2e0 * 1.1e0 / (2 * count(*)), 6) AS each, count(*) AS n FROM gt")
def g18_union_of_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Union of each truth box with a half of itself: the box."""

    def cover(pdf):
        import pandas as pd

        return pd.DataFrame([(int(pdf["gt"].iloc[0]), polygons.union_area(pdf["seg"]))], columns=["gt", "area"])

    t = _with_ring(views.truth(spark, sf)).select("gt", "seg")
    half = views.truth(spark, sf).withColumn("x2", (F.col("x1") + F.col("x2")) / 2)
    both = t.unionByName(_with_ring(half).select("gt", "seg"))
    u = both.groupBy("gt").applyInPandas(cover, "gt long, area double")
    return u.agg(F.round(F.avg("area"), 6).alias("each"), F.count("*").alias("n"))


@query(views.sql("gt") + f", p AS (SELECT gt, x1 + 0.3e0 AS x1, y1, x2 + 0.15e0 AS x2, y2 - 0.1e0 AS y2 FROM gt) SELECT round(sum({AREA.format('a')}), 4) AS pred_area, round((SELECT sum({AREA.format('gt')}) FROM gt), 4) AS gt_area, round(sum({INTER}), 4) AS common FROM p a JOIN gt b USING (gt)")
def a9_area_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Covered areas of moved truth boxes, which don't reach their neighbours."""
    g = views.truth(spark, sf)
    p = g.withColumns({"x1": F.col("x1") + 0.3, "x2": F.col("x2") + 0.15, "y2": F.col("y2") - 0.1})
    return scene_areas(p, g, 10.0).select(*[F.round(c, 4).alias(c) for c in ("pred_area", "gt_area", "common")])


@query()
def a9_scene_iou(spark: SparkSession, sf: str) -> DataFrame:
    p = fusion.suppressed(views.detections(spark, sf, True, True), 0.2)
    s = scene_areas(p, views.truth(spark, sf, True), 10.0)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _ground(height: float = 10.0, images: DataFrame | None = None):
    """Level ground of 400 x 600 cells, which are as large as the images' rays (under 63 degrees off the vertical) need."""
    import numpy as np

    x1, y1, x2, y2 = -150.0, -200.0, 450.0, 200.0
    at = images and images.agg(F.min("xs"), F.min("ys"), F.max("xs"), F.max("ys"), F.max("zs")).first()
    if at and at[0] is not None:
        far = 2 * max(at[4] - height, 1.0)
        x1, y1, x2, y2 = min(x1, at[0] - far), min(y1, at[1] - far), max(x2, at[2] + far), max(y2, at[3] + far)
    return terrain.Terrain.of(np.full((400, 600), height), (x1, (x2 - x1) / 600, 0.0, y2, 0.0, (y1 - y2) / 400))


@query(views.sql("img") + f", r AS (SELECT img, xs, ys, zs, {ROT} FROM img), p AS (SELECT *, c1 * 200e0 + c2 * -150e0 - c3 * 3713.29e0 AS den FROM r) SELECT img, round((10e0 - zs) * (a1 * 200e0 + a2 * -150e0 - a3 * 3713.29e0) / den + xs, 3) AS x, round((10e0 - zs) * (b1 * 200e0 + b2 * -150e0 - b3 * 3713.29e0) / den + ys, 3) AS y, 10e0 AS z FROM p")
def m8_ray_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Rays of one pixel of each image onto level ground."""
    cam, rays = Camera(), terrain.Rays(tolerance=1e-7)
    d = views.images(spark, sf)
    sent = spark.sparkContext.broadcast(_ground(images=d))

    def run(frames):
        import pandas as pd

        proj = terrain.Projector(sent.value, cam, rays)
        for pdf in frames:
            h = [proj.hits([[cam.cx + 200.0, cam.cy + 150.0]], p)[0] for p in pdf[["xs", "ys", "zs", "phi", "omega", "kappa"]].to_numpy()]
            yield pd.DataFrame([(i, *map(float, v)) for i, v in zip(pdf.img, h, strict=True)], columns=["img", "x", "y", "z"])

    d = d.select("img", "xs", "ys", "zs", "phi", "omega", "kappa").mapInPandas(run, "img long, x double, y double, z double")
    return d.select("img", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "z")


def _photo_features(spark: SparkSession, sf: str) -> DataFrame:
    """A small square in the middle of each image."""
    cam = Camera()
    d = views.images(spark, sf)
    for c, v in (("x1", cam.cx - 60), ("y1", cam.cy - 30), ("x2", cam.cx + 60), ("y2", cam.cy + 30)):
        d = d.withColumn(c, F.lit(v))
    return d.withColumn("seq", F.col("img")).withColumn("seg", F.array(box_ring()))


@query()
def m16_slope_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Plane under each feature on a tilted field."""
    import numpy as np

    y, x = np.mgrid[0:400, 0:600]
    t = terrain.Terrain.of(10.0 + 0.1 * (400 - y), (-150.0, 0.5, 0.0, 200.0, 0.0, -0.5))
    d = terrain.projected(_photo_features(spark, sf), t, Camera(), terrain.Rays(search_margin=200.0, most_height_diff=5.0), "slope")
    return d.select("seq", "method", F.round(F.degrees("tilt"), 2).alias("tilt"), F.size("seg").alias("rings"))


@query()
def m18_auto_projection(spark: SparkSession, sf: str) -> DataFrame:
    d = terrain.projected(_photo_features(spark, sf), _ground(), Camera(), terrain.Rays(), "auto")
    return d.groupBy("method").agg(F.count("*").alias("n"))


@query()
def k2_polygon_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Over-smaller overlap of polygon pairs of one image."""
    d = _with_ring(views.detections(spark, sf))
    p = tile_pairs(d, d, 2.6, ["img"], False, F.col("a.seq") < F.col("b.seq"))
    o = polygons.overlap_columns(F.col("a.seg"), F.col("a.box"), F.col("b.seg"), F.col("b.box"))
    return p.select("a.img", o.alias("o")).groupBy("img").agg(F.count("*").alias("pairs"), F.round(F.max("o.ios"), 6).alias("most"))


