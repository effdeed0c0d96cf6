"""Queries of scalar kernels: windows, rings, cameras, scores, filters, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera, names, rings, scores
from ..functions.boxes import box_ring
from ..operators import reports
from ..operators import windows as win
from . import views
from .registry import query

STARTS = "list_sort(list_distinct(list_append(generate_series(0, {n} - least(1024, {n}), greatest(1, CAST(floor(least(1024, {n}) * 0.5e0) AS INT))), {n} - least(1024, {n}))))"
WINDOWS = f", s AS (SELECT img, width, height, {STARTS.format(n='width')} AS xs, {STARTS.format(n='height')} AS ys FROM img), wins AS (SELECT img, CAST((iy - 1) * len(xs) + ix - 1 AS BIGINT) AS no, xs[ix] AS x, ys[iy] AS y, least(least(1024, width), width - xs[ix]) AS w, least(least(1024, height), height - ys[iy]) AS h FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS ix FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS iy FROM s)))"


@query(views.sql("img") + WINDOWS + " SELECT img, no, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM wins")
def p1_windows(spark: SparkSession, sf: str) -> DataFrame:
    return win.windows(views.images(spark, sf)).select("img", "no", *[F.col(c).cast("int").alias(c) for c in "xywh"])


BOX_COLS = ["CAST(p_partkey AS BIGINT) AS box", "CAST(p_partkey % 10 + 1 AS BIGINT) AS img", "(p_partkey * 37 % 2900) * 1e0 AS x1", "(p_partkey * 53 % 1900) * 1e0 AS y1", "(p_partkey * 37 % 2900) + 60e0 + p_size AS x2", "(p_partkey * 53 % 1900) + 40e0 + p_size AS y2"]
BOXES = f"SELECT {', '.join(BOX_COLS)} FROM part"
PROMPTS = ", boxes AS (" + BOXES + "), pr AS (SELECT *, row_number() OVER (PARTITION BY img, no ORDER BY ((((box + 42) * 48271) % 2147483647) * 16807 + 11) % 2147483647, box) AS k FROM (SELECT w.img, w.no, b.box, greatest(b.x1 - w.x, 0e0) AS x1, greatest(b.y1 - w.y, 0e0) AS y1, least(b.x2 - w.x, CAST(w.w AS DOUBLE)) AS x2, least(b.y2 - w.y, CAST(w.h AS DOUBLE)) AS y2 FROM wins w JOIN boxes b ON w.img = b.img AND b.x2 >= w.x AND b.x1 <= w.x + w.w AND b.y2 >= w.y AND b.y1 <= w.y + w.h))"


def _boxes(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(*BOX_COLS)


@query(views.sql("img") + WINDOWS + PROMPTS + " SELECT img, no, box, x1, y1, x2, y2 FROM pr WHERE k <= 3")
def p2_window_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_prompts(win.windows(views.images(spark, sf)), _boxes(spark, sf), 3)


@query(views.sql("img") + WINDOWS + PROMPTS + " SELECT img, no FROM wins w WHERE EXISTS (SELECT 1 FROM pr WHERE pr.img = w.img AND pr.no = w.no)")
def p3_strict_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = win.windows(views.images(spark, sf))
    return win.windows_with_prompts(w, win.window_prompts(w, _boxes(spark, sf), 0)).select("img", "no")


@query(views.sql("det") + " SELECT seq, score FROM det WHERE score >= 0.45e0 AND (x2 - x1) * (y2 - y1) * 250e0 >= 500e0")
def p4_early_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = views.detections(spark, sf).withColumn("pixel_area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * 250.0)
    return win.early_filter(d).select("seq", "score")


RING = "[x1, y1, x2, y1, x2, y2, x1, y2]"


@query(views.sql("gt") + f" SELECT gt, CAST(i AS INT) AS i, {RING}[i + 1] + CASE WHEN i % 2 = 0 THEN 100e0 ELSE 50e0 END AS v FROM gt, (SELECT unnest(range(0, 8)) AS i)")
def p8_shift_rings(spark: SparkSession, sf: str) -> DataFrame:
    d = views.truth(spark, sf).withColumn("seg", F.array(box_ring(), F.array(F.lit(1.0), F.lit(2.0))))
    moved = rings.shifted(F.col("seg"), F.lit(100.0), F.lit(50.0))  # the second ring has too few points
    return d.select("gt", F.explode(moved).alias("r")).select("gt", F.posexplode("r").alias("i", "v"))


@query(views.sql("gt") + " SELECT gt, x1, y1, x2, y2 FROM gt")
def p9_ring_bounds(spark: SparkSession, sf: str) -> DataFrame:
    d = views.truth(spark, sf).withColumn("b", rings.bounds(F.array(box_ring())))
    return d.select("gt", "b.x1", "b.y1", "b.x2", "b.y2")


@query(views.sql("img") + " SELECT img, CASE WHEN img % 4 = 0 THEN 'ortho' ELSE 'oblique' END AS kind FROM img")
def p10_image_kind(spark: SparkSession, sf: str) -> DataFrame:
    d = views.images(spark, sf).withColumn("geotransform", F.when(F.col("img") % 4 == 0, F.array(F.lit(1.0))))
    return d.select("img", names_kind(F.col("geotransform")).alias("kind"))


def names_kind(geotransform, mode: str = "auto"):
    """Images are of one kind by configuration, or with ``auto`` oblique where they have no geotransform."""
    return F.lit(mode) if mode != "auto" else F.when(geotransform.isNull(), "oblique").otherwise("ortho")


@query(views.sql("det") + " SELECT seq, CASE WHEN seq % 7 = 0 THEN 'affine_failed' WHEN seq % 3 = 0 THEN 'affine' ELSE 'collinearity' END AS method FROM det WHERE seq % 7 <> 0 AND score >= 0.7e0 AND label = 1")
def p12_score_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = views.detections(spark, sf).withColumn("method", F.when(F.col("seq") % 7 == 0, "affine_failed").when(F.col("seq") % 3 == 0, "affine").otherwise("collinearity"))
    return d.where(~F.endswith("method", F.lit("_failed")) & (F.col("score") >= 0.7) & (F.col("label") == 1)).select("seq", "method")


@query(views.sql("det") + " SELECT seq, img FROM det WHERE score >= 0.5e0 AND x2 - x1 >= 2.1e0 AND y2 - y1 >= 1e0 AND x1 >= 0 AND y1 >= 0 AND x2 <= 100e0 AND y2 <= 50e0")
def p15_prompt_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = views.detections(spark, sf)
    size = (F.col("x2") - F.col("x1") >= 2.1) & (F.col("y2") - F.col("y1") >= 1.0)
    return d.where((F.col("score") >= 0.5) & size & (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= 100) & (F.col("y2") <= 50)).select("seq", "img")


@query("SELECT s_suppkey AS img, 'IMG_' || s_suppkey || '_rank' || (s_suppkey % 4) AS safe, 'IMG_' || s_suppkey AS bare, 'site' || (s_nationkey % 3) AS station FROM supplier")
def p16_names(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    path = F.concat(F.lit("/data/a b/IMG:"), "s_suppkey", F.lit("_rank"), F.col("s_suppkey") % 4, F.lit(".shp"))
    run = F.concat(F.lit("site"), F.col("s_nationkey") % 3, F.when(F.col("s_suppkey") % 2 == 0, "-0518").otherwise("-exp12"))
    safe = names.safe_name(path)
    return s.select(F.col("s_suppkey").alias("img"), safe.alias("safe"), names.without_rank(safe).alias("bare"), names.station_of_run(run).alias("station"))


ROT = "cos(phi) * cos(kappa) - sin(phi) * sin(omega) * sin(kappa) AS a1, -cos(phi) * sin(kappa) - sin(phi) * sin(omega) * cos(kappa) AS a2, -sin(phi) * cos(omega) AS a3, cos(omega) * sin(kappa) AS b1, cos(omega) * cos(kappa) AS b2, -sin(omega) AS b3, sin(phi) * cos(kappa) + cos(phi) * sin(omega) * sin(kappa) AS c1, -sin(phi) * sin(kappa) + cos(phi) * sin(omega) * cos(kappa) AS c2, cos(phi) * cos(omega) AS c3"
COEF = [f"{a}{k}" for a in "abc" for k in (1, 2, 3)]


@query(views.sql("img") + f", r AS (SELECT img, {ROT} FROM img) SELECT img, {', '.join(f'round({c}, 12) AS {c}' for c in COEF)} FROM r")
def m1_rotation(spark: SparkSession, sf: str) -> DataFrame:
    r = camera.rotation(F.col("phi"), F.col("omega"), F.col("kappa"))
    return views.images(spark, sf).select("img", *[F.round(c, 12).alias(n) for c, n in zip(r, COEF, strict=True)])


@query(views.sql("img") + f", r AS (SELECT img, xs, ys, zs, {ROT} FROM img), g AS (SELECT *, 20e0 + img % 7 - xs AS dx, 10e0 + img % 5 - ys AS dy, 1.5e0 - zs AS dz FROM r) SELECT img, round(-3713.29e0 * (a1 * dx + b1 * dy + c1 * dz) / (a3 * dx + b3 * dy + c3 * dz), 6) AS px, round(-3713.29e0 * (a2 * dx + b2 * dy + c2 * dz) / (a3 * dx + b3 * dy + c3 * dz), 6) AS py FROM g")
def m2_ground_to_photo(spark: SparkSession, sf: str) -> DataFrame:
    d = views.images(spark, sf)
    p = camera.to_photo([20.0 + F.col("img") % 7, 10.0 + F.col("img") % 5, F.lit(1.5)], [F.col(c) for c in ("xs", "ys", "zs")], camera.rotation(F.col("phi"), F.col("omega"), F.col("kappa")), 3713.29)
    return d.select("img", F.round(p[0], 6).alias("px"), F.round(p[1], 6).alias("py"))


@query(views.sql("img") + f", r AS (SELECT img, xs, ys, zs, {ROT} FROM img), p AS (SELECT *, c1 * 500e0 + c2 * -300e0 - c3 * 3713.29e0 AS den FROM r) SELECT img, round((50e0 - zs) * (a1 * 500e0 + a2 * -300e0 - a3 * 3713.29e0) / den + xs, 6) AS x, round((50e0 - zs) * (b1 * 500e0 + b2 * -300e0 - b3 * 3713.29e0) / den + ys, 6) AS y FROM p")
def m3_photo_to_ground(spark: SparkSession, sf: str) -> DataFrame:
    d = views.images(spark, sf)
    g = camera.to_ground([F.lit(500.0), F.lit(-300.0)], F.lit(50.0), [F.col(c) for c in ("xs", "ys", "zs")], camera.rotation(F.col("phi"), F.col("omega"), F.col("kappa")), 3713.29)
    return d.select("img", F.round(g[0], 6).alias("x"), F.round(g[1], 6).alias("y"))


GT = [370000.5, 0.05, 0.001, 3312000.25, 0.002, -0.05]


@query(views.sql("gt") + " SELECT gt, round(370000.5e0 + x1 * 0.05e0 + y1 * 0.001e0, 6) AS mx, round(3312000.25e0 + x1 * 0.002e0 + y1 * -0.05e0, 6) AS my, round(x1, 4) AS bx, round(y1, 4) AS by FROM gt")
def m4_affine_map(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels to the map and back."""
    g = [F.lit(v) for v in GT]
    m = camera.pixel_to_map(g, F.col("x1"), F.col("y1"))
    d = views.truth(spark, sf).select("gt", m[0].alias("mx"), m[1].alias("my"))
    b = camera.map_to_pixel(g, F.col("mx"), F.col("my"))
    back = lambda v: F.round(v, 4) + 0.0
    return d.select("gt", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), back(b[0]).alias("bx"), back(b[1]).alias("by"))


@query(views.sql("gt") + f" SELECT gt, CAST(i AS INT) AS i, round(CASE WHEN i % 2 = 0 THEN 370000.5e0 + {RING}[i + 1] * 0.05e0 + {RING}[i + 2] * 0.001e0 ELSE 3312000.25e0 + {RING}[i] * 0.002e0 + {RING}[i + 1] * -0.05e0 END, 6) AS v FROM gt, (SELECT unnest(range(0, 8)) AS i)")
def m5_affine_rings(spark: SparkSession, sf: str) -> DataFrame:
    d = views.truth(spark, sf).withColumn("r", rings.affine(F.array(box_ring()), [F.lit(v) for v in GT])[0])
    return d.select("gt", F.posexplode("r").alias("i", "v")).withColumn("v", F.round("v", 6))


DIRECTION = "CASE WHEN degrees(sqrt(phi * phi + omega * omega)) < 10 THEN 'nadir' ELSE 'az' || CAST(CAST(floor((degrees(kappa) - floor(degrees(kappa) / 360) * 360) / 45) * 45 AS INT) AS VARCHAR) END"


@query(views.sql("img") + f" SELECT img, {DIRECTION} AS direction FROM img")
def m26_direction(spark: SparkSession, sf: str) -> DataFrame:
    return views.images(spark, sf).select("img", camera.direction(F.col("phi"), F.col("omega"), F.col("kappa")).alias("direction"))


@query(views.sql("img") + f" SELECT {DIRECTION} AS direction, count(*) AS n FROM img GROUP BY ALL")
def a20_direction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return m26_direction(spark, sf).groupBy("direction").agg(F.count("*").alias("n"))


CORNERS = ", ".join(f"(50e0 - zs) * ({a}1 * {x} + {a}2 * {y} - {a}3 * 3713.29e0) / (c1 * {x} + c2 * {y} - c3 * 3713.29e0) + {a2}" for a, a2 in (("a", "xs"), ("b", "ys")) for x, y in (("-2647.02e0", "1969.28e0"), ("2632.98e0", "1969.28e0"), ("2632.98e0", "-1986.72e0"), ("-2647.02e0", "-1986.72e0")))


@query(views.sql("img") + f", r AS (SELECT img, xs, ys, zs, {ROT} FROM img), c AS (SELECT img, [{CORNERS}] AS v FROM r) SELECT img, round(list_min(v[1:4]), 5) AS x1, round(list_min(v[5:8]), 5) AS y1, round(list_max(v[1:4]), 5) AS x2, round(list_max(v[5:8]), 5) AS y2 FROM c")
def m21_footprints(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.prompts import footprints

    d = footprints(views.images(spark, sf), camera.Camera(mean_height=50.0))
    return d.select("img", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(views.sql("gt") + " SELECT gt, round((y2 - 60e0) / -0.5e0, 6) AS dummy, greatest(0e0, least(x1 / 0.25e0, 480e0)) AS x1, greatest(0e0, least((60e0 - y2) / 0.25e0, 400e0)) AS y1, greatest(0e0, least(x2 / 0.25e0, 480e0)) AS x2, greatest(0e0, least((60e0 - y1) / 0.25e0, 400e0)) AS y2 FROM gt WHERE greatest(0e0, least(x2 / 0.25e0, 480e0)) > greatest(0e0, least(x1 / 0.25e0, 480e0)) AND greatest(0e0, least((60e0 - y1) / 0.25e0, 400e0)) > greatest(0e0, least((60e0 - y2) / 0.25e0, 400e0))".replace("round((y2 - 60e0) / -0.5e0, 6) AS dummy, ", ""))
def m24_ortho_boxes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.prompts import ortho_boxes

    return ortho_boxes(views.truth(spark, sf), [0.0, 0.25, 0.0, 60.0, 0.0, -0.25], 480, 400).select("gt", "x1", "y1", "x2", "y2")


@query(views.sql("det") + " SELECT seq, (x2 - x1) * (y2 - y1) AS area FROM det".replace("(x2 - x1) * (y2 - y1)", "abs(((x1 * y1 - x2 * y1) + (x2 * y2 - x2 * y1) + (x2 * y2 - x1 * y2) + (x1 * y1 - x1 * y2)) / 2)").replace("SELECT seq, abs(", "SELECT seq, round(abs(").replace(" / 2) AS area", " / 2), 6) AS area"))
def g2_shoelace(spark: SparkSession, sf: str) -> DataFrame:
    return views.detections(spark, sf).select("seq", F.round(rings.ring_area(box_ring()), 6).alias("area"))


@query(views.sql("gt") + " SELECT gt, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM gt")
def g14_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = rings.ring_centroid(box_ring())
    return views.truth(spark, sf).select("gt", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


TRAITS = ", t AS (SELECT seq, score, (x2 - x1) * (y2 - y1) AS area, greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) AS ratio FROM det), p AS (SELECT seq, score, exp(-abs(area - 2.2e0 * 1.1e0) / (2.2e0 * 1.1e0 * 0.8e0)) AS sa, exp(-((ratio - 2.2e0 / 1.1e0) * (ratio - 2.2e0 / 1.1e0)) / (2 * 0.35e0 * 0.35e0)) AS sr, 1e0 AS ss FROM t), q AS (SELECT *, (15 * sa + 10 * sr + 5 * ss) / 30 AS con_pv FROM p)"


@query(views.sql("det") + TRAITS + " SELECT seq, round(sa, 9) AS area_score, round(sr, 9) AS ratio_score, round(ss, 9) AS shape_score, round(con_pv, 9) AS con_pv FROM q")
def g10_pv_score(spark: SparkSession, sf: str) -> DataFrame:
    d = scored(views.detections(spark, sf))
    return d.select("seq", *[F.round(c, 9).alias(c) for c in ("area_score", "ratio_score", "shape_score", "con_pv")])


def scored(d: DataFrame, p: scores.Prior = scores.Prior()) -> DataFrame:
    """Boxes with their trait scores, con_pv and con_weight; a box is its own enclosing rectangle."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = scores.trait_scores(w * h, w, h, w * h, p)
    d = d.withColumns(t)
    return d.withColumn("con_pv", scores.prior_score({k: F.col(k) for k in t}, p)).withColumn("con_weight", scores.fused_weight(F.col("score"), F.col("con_pv"), p))


@query(views.sql("det") + TRAITS + " SELECT seq, round((0.2e0 * score + 0.8e0 * con_pv) / (0.2e0 + 0.8e0), 9) AS con_weight FROM q")
def g11_con_weight(spark: SparkSession, sf: str) -> DataFrame:
    return scored(views.detections(spark, sf)).select("seq", F.round("con_weight", 9).alias("con_weight"))


@query(views.sql("det") + " SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN NULL ELSE score END, CASE WHEN seq % 2 = 0 THEN NULL ELSE 0.25e0 END, 0.5e0) AS score FROM det")
def s4_score_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.features import with_defaults

    d = views.detections(spark, sf).select("seq", F.when(F.col("seq") % 3 != 0, F.col("score")).alias("con_weight"), F.when(F.col("seq") % 2 != 0, F.lit(0.25)).alias("con"), F.lit(0.5).alias("con_sem"))
    return with_defaults(d).select("seq", "score")


@query("SELECT o_custkey AS name, last(o_orderkey ORDER BY o_orderkey) AS pose FROM orders GROUP BY o_custkey")
def s10_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import last_wins

    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("pose"))
    return last_wins(o, ["name"], "pose")


@query("SELECT * FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY user_id, event_type)")
def u4_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_at"))


@query(views.sql("img") + " SELECT s_suppkey AS img FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey NOT IN (SELECT img FROM img WHERE station = 1)")
def j11_missing_pose(spark: SparkSession, sf: str) -> DataFrame:
    """Images without a pose, and raw files not yet projected."""
    i = views.images(spark, sf)
    return i.where("img % 3 <> 0").select("img").join(i.where("station = 1").select("img"), "img", "left_anti")


POSES = ", p AS (SELECT CASE img % 3 WHEN 0 THEN src WHEN 1 THEN 'img_' || img ELSE lower(src) END AS name, img AS pose FROM img WHERE img % 5 <> 0)"


@query(views.sql("img") + POSES + " SELECT '/data/x/' || i.src AS path, p.pose FROM img i LEFT JOIN p ON p.pose = i.img")
def j7_pose_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import keyed_by_name

    i = views.images(spark, sf)
    key = F.when(F.col("img") % 3 == 0, F.col("src")).when(F.col("img") % 3 == 1, F.concat(F.lit("img_"), "img")).otherwise(F.lower("src"))
    poses = i.where("img % 5 <> 0").select(key.alias("name"), F.col("img").alias("pose"))
    return keyed_by_name(i.select(F.concat(F.lit("/data/x/"), "src").alias("path")), "path", poses).select("path", "pose")


@query(views.sql("img") + f", d AS (SELECT img, {DIRECTION} AS direction FROM img), g AS (SELECT direction, row_number() OVER (ORDER BY CASE WHEN direction = 'nadir' THEN 0 ELSE 1 END, direction) AS no FROM (SELECT DISTINCT direction FROM d)) SELECT CAST(unnest(range(no, (SELECT max(no) FROM g) + 1)) AS INT) AS set, img FROM d JOIN g USING (direction)")
def w5_view_sets(spark: SparkSession, sf: str) -> DataFrame:
    return reports.view_sets(m26_direction(spark, sf))
