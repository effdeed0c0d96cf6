"""Queries of set operations, rankings, running values, fits and grouped evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import iou
from ..operators import evaluate as ev
from ..operators import fusion
from ..operators.ordering import placed
from ..sources import features, tables
from . import detection, views
from .fusion_queries import AREA, CLOSED, IOU, TP, greedy_fold, listed
from .registry import query
from .scalar_queries import GT, _boxes
from .sweep import sweep


# ---- sources

@query("SELECT stage, n FROM (SELECT event_type AS stage, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def s16_json_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines and back."""
    lines = spark.read.parquet(f"{sf}/events.parquet").select(F.to_json(F.struct(F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"))).alias("value"))
    row = lines.select(F.from_json("value", "stage string, elapsed_ms double").alias("r")).select("r.*")
    return row.where("elapsed_ms is not null").groupBy("stage").agg(F.count("*").alias("n"))


@query("SELECT CAST(s_suppkey % 4 AS INT) AS iter, 'v' || (s_suppkey % 3) AS variant, count(*) AS files FROM supplier GROUP BY ALL")
def s21_result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Both nestings of iteration and variant folders."""
    k = F.col("s_suppkey")
    it, v = F.concat(F.lit("iter_"), k % 4), F.concat(F.lit("v"), k % 3)
    path = F.concat(F.lit("/out/"), F.when(k % 2 == 0, F.concat_ws("/", it, v)).otherwise(F.concat_ws("/", v, it)), F.lit("/final.shp"))
    d = tables.result_files(spark.read.parquet(f"{sf}/supplier.parquet").select(path.alias("path")))
    return d.groupBy("iter", "variant").agg(F.count("*").alias("files"))


@query(views.sql("det") + " SELECT seq AS id, src, round(score, 9) AS con FROM det WHERE seq % 11 <> 0")
def s6_export(spark: SparkSession, sf: str) -> DataFrame:
    """Export rows: ids count rows that can't be drawn, which are left out."""
    d = views.detections(spark, sf)
    d = d.withColumn("x1", F.when(F.col("seq") % 11 != 0, F.col("x1")))
    return features.exported(d).select(F.col("id").cast("long").alias("id"), "src", F.round("con", 9).alias("con"))


# ---- sets

@query(views.sql("det", "ortho") + " SELECT kind, count(*) AS n, round(sum(score), 6) AS total FROM (SELECT 'view' AS kind, score FROM det UNION ALL SELECT 'ortho', score FROM ortho) GROUP BY kind")
def u2_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    both = views.detections(spark, sf).select(F.lit("view").alias("kind"), "score").unionByName(views.ortho(spark, sf).select(F.lit("ortho").alias("kind"), "score"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("SELECT l_suppkey AS img FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0")
def u6_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Images with raw features that aren't projected yet."""
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("img")).distinct()
    return raw.join(spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("img")), "img", "left_anti")


@query("SELECT round(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.975]), 3)::DOUBLE AS thr")
def u5_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array_sort(F.array_union(F.array(*map(F.lit, ev.COCO)), F.array(*map(F.lit, ev.STRICT))))).alias("thr"))


@query("SELECT s.s_suppkey AS img, v.img AS in_set FROM supplier s JOIN (SELECT s_suppkey AS img FROM supplier WHERE s_nationkey < 10) v ON v.img = s.s_suppkey")
def j12_view_set(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    keep = s.where("s_nationkey < 10").select(F.col("s_suppkey").alias("img"))
    return s.select(F.col("s_suppkey").alias("img")).join(keep, "img", "left_semi").select("img", F.col("img").alias("in_set"))


@query(views.sql("img") + " SELECT DISTINCT d.src AS raw, i.src IS NULL AS missing FROM (SELECT 'img_' || l_suppkey || '.JPG' AS src FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL SELECT 'img_none.JPG') d LEFT JOIN img i USING (src)")
def j8_raw_to_image(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files with their images; those without one are told, not lost."""
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey % 2 = 0").select(F.concat(F.lit("img_"), "l_suppkey", F.lit(".JPG")).alias("src")).distinct()
    raw = raw.unionByName(spark.range(1).select(F.lit("img_none.JPG").alias("src")))
    return raw.join(views.images(spark, sf).select("src", F.lit(1).alias("one")), "src", "left").select(F.col("src").alias("raw"), F.col("one").isNull().alias("missing"))


# ---- rankings and running values

@query(views.sql("det") + " SELECT seq, CAST(row_number() OVER (ORDER BY score DESC, seq) AS BIGINT) AS place FROM det")
def w4_places(spark: SparkSession, sf: str) -> DataFrame:
    return placed(views.detections(spark, sf).select("seq", "score"), [F.desc("score"), F.asc("seq")]).select("seq", "place")


RUN = ", r AS (SELECT thr.thr, det.seq, det.score, CASE WHEN m.seq IS NULL THEN 0 ELSE 1 END AS hit FROM thr CROSS JOIN det LEFT JOIN m ON m.seq = det.seq AND m.thr = thr.thr), t AS (SELECT thr, seq, sum(hit) OVER w AS tp, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY thr ORDER BY score DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(views.sql("det", "gt") + TP.format(thr=listed((0.5, 0.9))) + RUN + " SELECT thr, seq, CAST(tp AS BIGINT) AS tp, CAST(n - tp AS BIGINT) AS fp FROM t")
def w1_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    """True and false positives so far in score order."""
    p = views.detections(spark, sf, keep=True)
    m = ev.matched(ev.overlap_pairs(p, views.truth(spark, sf)), (0.5, 0.9)).select("thr", "seq", F.lit(1).alias("hit"))
    d = placed(p.select("seq", "score"), [F.desc("score"), F.asc("seq")]).withColumn("thr", F.explode(F.array(F.lit(0.5), F.lit(0.9))))
    so_far = W.partitionBy("thr").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    d = d.join(m, ["thr", "seq"], "left").withColumn("tp", F.sum(F.coalesce("hit", F.lit(0))).over(so_far))
    return d.select("thr", "seq", F.col("tp").cast("long").alias("tp"), (F.col("place") - F.col("tp")).cast("long").alias("fp"))


@query(views.sql("det", "gt") + TP.format(thr=listed((0.5, 0.9))) + RUN + ", h AS (SELECT t.thr, t.seq, tp, tp / n AS p FROM t JOIN m ON m.seq = t.seq AND m.thr = t.thr) SELECT thr, seq, max(p) OVER (PARTITION BY thr ORDER BY tp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM h")
def w2_precision_envelope(spark: SparkSession, sf: str) -> DataFrame:
    p = views.detections(spark, sf, keep=True)
    m = ev.matched(ev.overlap_pairs(p, views.truth(spark, sf)), (0.5, 0.9)).select("thr", "seq")
    d = m.join(placed(p.select("seq", "score"), [F.desc("score"), F.asc("seq")]).select("seq", "place"), "seq")
    by = W.partitionBy("thr").orderBy("place")
    d = d.withColumn("p", F.row_number().over(by) / F.col("place"))
    return d.select("thr", "seq", F.max("p").over(W.partitionBy("thr").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, W.currentRow)).alias("env"))


@query(views.sql("gt", "ortho") + f" SELECT gt, first(seq ORDER BY score DESC, seq) AS best FROM (SELECT b.gt, a.seq, a.score FROM ortho a JOIN gt b ON {CLOSED} AND {IOU} > 0.05e0) GROUP BY gt")
def l4_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.tile_join import tile_pairs

    p = tile_pairs(views.ortho(spark, sf), views.truth(spark, sf), 2.6).where(iou("a", "b") > 0.05)
    return p.groupBy("b.gt").agg(F.max_by("a.seq", F.struct("a.score", (-F.col("a.seq")).alias("s"))).alias("best"))


@query("SELECT CAST(s_suppkey % 4 AS INT) AS worker, count(*) AS n FROM supplier GROUP BY ALL")
def l6_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.pmod("s_suppkey", F.lit(4)).cast("int").alias("worker")).agg(F.count("*").alias("n"))


@query(views.sql("results") + ", c AS (SELECT station, variant, iter, n_pred FROM results) SELECT station, variant, iter, CAST(sum(n_pred) OVER (PARTITION BY station, variant ORDER BY iter) AS BIGINT) AS so_far FROM c")
def w6_cost_so_far(spark: SparkSession, sf: str) -> DataFrame:
    by = W.partitionBy("station", "variant").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    return views.results(spark, sf).select("station", "variant", "iter", F.sum("n_pred").over(by).alias("so_far"))


@query(views.sql("runs") + " SELECT run_no % 5 AS job, CAST(floor((row_number() OVER (PARTITION BY run_no % 5 ORDER BY seq) - 1) / 4) AS BIGINT) AS chunk, seq FROM runs")
def w7_invocations(spark: SparkSession, sf: str) -> DataFrame:
    r = views.run_log(spark, sf).withColumn("job", F.col("run_no") % 5)
    n = F.row_number().over(W.partitionBy("job").orderBy("seq"))
    return r.select("job", F.floor((n - 1) / 4).alias("chunk"), "seq")


@query(views.sql("det") + " SELECT module, round(sum(x1 * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9) AS mean, array_to_string(list_sort(list_distinct(list(src))), ';') AS src FROM det GROUP BY module")
def a2_weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    d = views.detections(spark, sf)
    return d.groupBy("module").agg(F.round(fusion.weighted_mean(F.col("x1"), F.col("score")), 9).alias("mean"), F.array_join(F.array_sort(F.collect_set("src")), ";").alias("src"))


@query(views.sql("det") + " SELECT img, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM det GROUP BY img")
def a4_extents(spark: SparkSession, sf: str) -> DataFrame:
    return views.detections(spark, sf).groupBy("img").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))


# ---- fits and grids



@query(f"SELECT {', '.join(f'{v!r}::DOUBLE AS g{k}' for k, v in enumerate([round(x, 3) for x in GT]))}")
def m7_affine_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares from sums alone: one pass, one row; the coefficients that made the map points come back."""
    b = _boxes(spark, sf).select(F.col("x1").alias("x"), F.col("y1").alias("y"))
    mx, my = GT[0] + F.col("x") * GT[1] + F.col("y") * GT[2], GT[3] + F.col("x") * GT[4] + F.col("y") * GT[5]
    b = b.withColumn("u", mx - 370000.0).withColumn("v", my - 3312000.0)
    m = b.agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"], *[F.covar_pop(a, c).alias(f"{a}{c}") for a, c in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda t: ((F.col(f"x{t}") * F.col("yy") - F.col(f"y{t}") * F.col("xy")) / det, (F.col(f"y{t}") * F.col("xx") - F.col(f"x{t}") * F.col("xy")) / det)
    (a, c), (d, e) = solve("u"), solve("v")
    g0 = F.col("mu") - a * F.col("mx") - c * F.col("my") + 370000.0
    g3 = F.col("mv") - d * F.col("mx") - e * F.col("my") + 3312000.0
    return m.select(*[(F.round(v, 3) + 0.0).alias(f"g{k}") for k, v in enumerate((g0, a, c, g3, d, e))])


DSM = "SELECT CAST(p_partkey % 40 AS INT) AS c, CAST(floor(p_partkey / 40) AS INT) AS r, CASE WHEN p_partkey % 17 = 0 THEN -9999e0 ELSE 30e0 + p_size / 10e0 END AS z FROM part"
DSM_COLS = ["CAST(p_partkey % 40 AS INT) AS c", "CAST(floor(p_partkey / 40) AS INT) AS r", "CASE WHEN p_partkey % 17 = 0 THEN -9999e0 ELSE 30e0 + p_size / 10e0 END AS z"]


@query(f"SELECT min(z) AS low, max(z) AS high FROM ({DSM}) WHERE z <> -9999")
def m10_height_range(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet").selectExpr(*DSM_COLS)
    return d.where("z <> -9999").agg(F.min("z").alias("low"), F.max("z").alias("high"))


@query(f"WITH d AS ({DSM}) SELECT a.r, a.c, quantile_cont(b.z, 0.5) AS median FROM d a JOIN d b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c")
def m11_window_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the 3 x 3 cells around each cell: each cell tells its neighbours, so the join is an aggregate by key."""
    d = spark.read.parquet(f"{sf}/part.parquet").selectExpr(*DSM_COLS)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    told = d.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "z")
    there = d.select("r", "c").distinct()
    return told.join(there, ["r", "c"], "left_semi").groupBy("r", "c").agg(F.percentile("z", F.lit(0.5)).alias("median"))


PLANE = (0.1, -0.05, 12.0)


@query(views.sql("img") + ", d AS (SELECT img, xs, ys, zs, 300e0 * cos(kappa) AS dx, 300e0 * sin(kappa) AS dy, -3713.29e0 AS dz FROM img), t AS (SELECT *, (12e0 + 0.1e0 * xs + -0.05e0 * ys - zs) / (dz - 0.1e0 * dx - -0.05e0 * dy) AS t FROM d) SELECT img, round(xs + t * dx, 6) AS x, round(ys + t * dy, 6) AS y, round(zs + t * dz, 6) AS z FROM t")
def m17_ray_plane(spark: SparkSession, sf: str) -> DataFrame:
    """One ray of each image on a tilted plane."""
    a, b, c = PLANE
    d = views.images(spark, sf)
    dx, dy, dz = 300.0 * F.cos("kappa"), 300.0 * F.sin("kappa"), F.lit(-3713.29)
    t = (c + a * F.col("xs") + b * F.col("ys") - F.col("zs")) / (dz - a * dx - b * dy)
    return d.select("img", *[F.round(F.col(f"{n}s") + t * v, 6).alias(n) for n, v in (("x", dx), ("y", dy), ("z", dz))])


# ---- whole evaluations

@query(views.sql("det", "gt") + TP.format(thr=listed((0.5,))) + ", n AS (SELECT img % 3 AS station, count(*) AS n_pred FROM det GROUP BY ALL), h AS (SELECT station, count(*) AS tp FROM (SELECT img % 3 AS station, b.gt, row_number() OVER (PARTITION BY img % 3, b.gt ORDER BY score DESC, seq) AS k FROM det a JOIN gt b ON a.module = b.gt AND " + IOU + " >= 0.5e0) WHERE k = 1 GROUP BY station) SELECT n.station, n_pred, coalesce(tp, 0) AS tp, (SELECT count(*) FROM gt) - coalesce(tp, 0) AS fn FROM n LEFT JOIN h USING (station)")
def e8_stations(spark: SparkSession, sf: str) -> DataFrame:
    """Several stations in one job: the station is a key of the pairs and of the matching."""
    p = views.detections(spark, sf, keep=True).withColumn("station", F.col("img") % 3)
    g = views.truth(spark, sf).withColumn("station", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    m = ev.matched(ev.overlap_pairs(p, g, ["station"]), (0.5,), ["station"], ())
    n = p.groupBy("station").agg(F.count("*").alias("n_pred")).join(g.groupBy("station").agg(F.count("*").alias("n_gt")), "station")
    out = n.join(m.groupBy("station").agg(F.count("*").alias("tp")), "station", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.select("station", "n_pred", "tp", (F.col("n_gt") - F.col("tp")).alias("fn"))


@query(views.sql("det", "gt") + f", k AS (SELECT part AS module, k.seq AS seq, -k.score AS score, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM ({greedy_fold('det', 'module', '0.2e0')})), e AS (SELECT b.gt, {IOU} AS iou FROM k a JOIN gt b ON a.module = b.gt) SELECT round(avg(iou), 6) AS sq, count(*) AS tp FROM e WHERE iou >= 0.5e0")
def e4_fused_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of the suppressed detections."""
    p = fusion.suppressed(views.detections(spark, sf, keep=True), 0.2)
    m = ev.matched(ev.overlap_pairs(p, views.truth(spark, sf)), (0.5,))
    return m.agg(F.round(F.avg("iou"), 6).alias("sq"), F.count("*").alias("tp"))


@query()
def e11_vote_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = sweep(views.detections(spark, sf, keep=True), views.truth(spark, sf), (0.2,), (2, 15), (0.0, 0.5))
    return s.select("cell", "min_votes", "min_area", "n_pred", F.round("f1", 6).alias("f1"), F.round("sq", 6).alias("sq"))


@query("SELECT 'fail' AS level, 'image without pose' AS what, count(*) AS n FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'warn', 'pose without image', 1 UNION ALL SELECT 'fail', 'repeated image', 0")
def e12_preflight(spark: SparkSession, sf: str) -> DataFrame:
    i = views.images(spark, sf).select("src", "img")
    p = i.where("img % 7 <> 0").select("src").unionByName(spark.range(1).select(F.lit("lost.JPG").alias("src")))
    return detection.preflight(i.select("src"), p)


@query(views.sql("det") + f" SELECT count(*) AS n, round(sum({AREA.format('det')}), 4) AS area FROM det")
def a3_total_area(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.boxes import box_area

    return views.detections(spark, sf).agg(F.count("*").alias("n"), F.round(F.sum(box_area()), 4).alias("area"))


@query(views.sql("results") + ", a AS (SELECT iter, sum(tp) / sum(n_pred) AS f1, sum(n_pred) AS n FROM results GROUP BY iter) SELECT a.iter, abs(a.f1 - b.f1) < 0.005e0 AND abs(a.n - b.n) < 0.01e0 * b.n AS settled FROM a JOIN a b ON a.iter = b.iter + 1")
def e14_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each round changed little against the one before."""
    r = views.results(spark, sf).groupBy("iter").agg((F.sum("tp") / F.sum("n_pred")).alias("f1"), F.sum("n_pred").alias("n"))
    b = r.select((F.col("iter") + 1).alias("iter"), F.col("f1").alias("f0"), F.col("n").alias("n0"))
    return r.join(b, "iter").select("iter", ((F.abs(F.col("f1") - F.col("f0")) < 0.005) & (F.abs(F.col("n") - F.col("n0")) < 0.01 * F.col("n0"))).alias("settled"))


