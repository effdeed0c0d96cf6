"""Queries over the derived detections: spatial joins, suppression, merging, views, votes, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import iou, over_smaller
from ..operators import evaluate as ev
from ..operators import fusion, votes
from ..operators.tile_join import near_pairs, tile_pairs
from . import views
from .registry import query

# SQL of the same rules, for the checker
INTER = "greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
IOU = f"(CASE WHEN {INTER} > 0 THEN {INTER} / ({AREA.format('a')} + {AREA.format('b')} - {INTER}) ELSE 0e0 END)"
TILED = "SELECT *, unnest(generate_series(CAST(floor(x1 / 2.6e0) AS BIGINT), CAST(floor(x2 / 2.6e0) AS BIGINT))) AS tx FROM {0}"
OPEN = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
CLOSED = "a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"


def tiles(name: str, src: str) -> str:
    """A view of boxes by tile, so that DuckDB joins them by equality too."""
    return f"{name} AS (SELECT *, unnest(generate_series(CAST(floor(y1 / 1.5e0) AS BIGINT), CAST(floor(y2 / 1.5e0) AS BIGINT))) AS ty FROM ({TILED.format(src)}))"


SAME_TILE = "a.tx = b.tx AND a.ty = b.ty AND floor(greatest(a.x1, b.x1) / 2.6e0) = a.tx AND floor(greatest(a.y1, b.y1) / 1.5e0) = a.ty"


def greedy_fold(view: str, part: str, threshold: str, over: str = "union") -> str:
    """Rows (part, seq) kept by a scan of each part in score order, as a list fold."""
    w = "(least(k.x2, x.x2) - greatest(k.x1, x.x1))"
    h = "(least(k.y2, x.y2) - greatest(k.y1, x.y1))"
    ka, xa = "((k.x2 - k.x1) * (k.y2 - k.y1))", "((x.x2 - x.x1) * (x.y2 - x.y1))"
    base = f"({ka} + {xa} - {w} * {h})" if over == "union" else f"least({ka}, {xa})"
    hit = f"({w} > 0 AND {h} > 0 AND {w} * {h} / {base} > {threshold})"
    return f"""SELECT part, unnest(kept) AS k FROM (SELECT {part} AS part, list_reduce(list_transform(list({{'score': -score, 'seq': seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -score, seq), lambda r: [r]),
    lambda acc, one: CASE WHEN len(list_filter(acc, lambda k: list_transform(one, lambda x: {hit})[1])) = 0 THEN list_concat(acc, one) ELSE acc END) AS kept FROM {view} GROUP BY {part})"""


# ---- joins

@query(views.sql("det", "gt") + f", {tiles('d', 'det')}, {tiles('g', 'gt')} SELECT a.seq, b.gt, {IOU} AS iou, {INTER} AS inter FROM d a JOIN g b ON {SAME_TILE} AND {OPEN}")
def j2_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ev.overlap_pairs(views.detections(spark, sf), views.truth(spark, sf)).select("seq", "gt", "iou", "inter")


@query(views.sql("gt", "ortho") + f", {tiles('d', 'ortho')}, {tiles('g', 'gt')} SELECT a.seq, b.gt, {IOU} AS iou, CASE WHEN {INTER} > 0 THEN {INTER} / least({AREA.format('a')}, {AREA.format('b')}) ELSE 0e0 END AS ios FROM d a JOIN g b ON {SAME_TILE} AND {CLOSED}")
def g1_bbox_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = tile_pairs(views.ortho(spark, sf), views.truth(spark, sf), 2.6)
    return p.select("a.seq", "b.gt", iou("a", "b").alias("iou"), over_smaller("a", "b").alias("ios"))


@query(views.sql("drift") + f", {tiles('d', 'drift')} SELECT a.img, count(*) AS pairs, CAST(sum(CASE WHEN {IOU} > 0.2e0 THEN 1 ELSE 0 END) AS BIGINT) AS near FROM d a JOIN d b ON {SAME_TILE} AND {CLOSED} AND a.img = b.img AND a.seq < b.seq GROUP BY a.img")
def j1_self_pairs_per_image(spark: SparkSession, sf: str) -> DataFrame:
    d = views.detections(spark, sf, drift=True).select("seq", "img", "x1", "y1", "x2", "y2")
    p = tile_pairs(d, d, 3.5, ["img"], True, F.col("a.seq") < F.col("b.seq"))
    return p.groupBy(F.col("a.img").alias("img")).agg(F.count("*").alias("pairs"), F.sum(F.when(iou("a", "b") > 0.2, 1).otherwise(0)).alias("near"))


@query(views.sql("gt") + ", c AS (SELECT gt AS seq, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM gt) SELECT a.seq AS a, b.seq AS b FROM c a JOIN c b ON a.seq < b.seq AND abs(a.x - b.x) <= 2.5e0 AND abs(a.y - b.y) <= 2.5e0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.5e0 * 2.5e0")
def j4_centroid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = views.truth(spark, sf).select(F.col("gt").alias("seq"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return near_pairs(c, 2.5).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


FOOT = "SELECT img, xs - 15e0 AS x1, ys - 10e0 AS y1, xs + 15e0 AS x2, ys + 10e0 AS y2 FROM img"


@query(views.sql("det", "img") + f", f AS ({FOOT}) SELECT img, count(*) AS boxes, CAST(sum(own) AS BIGINT) AS own FROM (SELECT seq, img, max(own) AS own FROM (SELECT a.seq, b.img, 0 AS own FROM det a JOIN f b ON {CLOSED} UNION ALL SELECT seq, img, 1 FROM det) GROUP BY seq, img) GROUP BY img")
def j5_feature_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Each box with the images whose ground footprint it meets, and its own image; by image."""
    d = views.detections(spark, sf).select("seq", "img", "x1", "y1", "x2", "y2")
    foot = views.images(spark, sf).select("img", (F.col("xs") - 15).alias("x1"), (F.col("ys") - 10).alias("y1"), (F.col("xs") + 15).alias("x2"), (F.col("ys") + 10).alias("y2"))
    met = tile_pairs(d, foot, 10.0).select("a.seq", "b.img", F.lit(0).alias("own"))
    every = met.unionByName(d.select("seq", "img", F.lit(1).alias("own"))).groupBy("seq", "img").agg(F.max("own").alias("own"))
    return every.groupBy("img").agg(F.count("*").alias("boxes"), F.sum("own").alias("own"))


# ---- greedy selection

@query(views.sql("det") + f" SELECT part AS img, k.seq AS seq FROM ({greedy_fold('det', 'img', '0.2e0')})")
def k1_nms_per_image(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.suppressed(views.detections(spark, sf, keep=True), 0.2, ["img"]).select("img", "seq")


@query(views.sql("det") + f" SELECT k.seq AS seq, -k.score AS score FROM ({greedy_fold('det', 'module', '0.2e0')})")
def k1_nms_global(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.suppressed(views.detections(spark, sf, keep=True), 0.2).select("seq", "score")


@query()
def k1_nms_global_drift(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.suppressed(views.detections(spark, sf, drift=True, keep=True), 0.2).select("seq", "score")


HEADS = ", h AS (SELECT part, k.seq AS head, k.score AS s, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM ({fold})), m AS (SELECT a.*, first(b.head ORDER BY b.s, b.head) AS head FROM det a JOIN h b ON a.module = b.part AND (a.seq = b.head OR {hit}) GROUP BY ALL)"
IOS_HIT = f"{INTER} / least({AREA.format('a')}, {AREA.format('b')}) > 0.5e0"


@query(views.sql("det") + HEADS.format(fold=greedy_fold("det", "module", "0.5e0", "smaller"), hit=IOS_HIT) + " SELECT head, count(*) AS n, max(CASE WHEN seq = head THEN score END) AS score, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM m GROUP BY head")
def k2_nmm_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.merged_groups(views.detections(spark, sf, keep=True), 0.5)


@query(views.sql("det") + HEADS.format(fold=greedy_fold("det", "module", "0.2e0"), hit=f"{IOU} > 0.2e0") + " SELECT head, count(*) AS n, round(sum(score * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9) AS con_weight, count(DISTINCT src) AS sources, min(src) AS first_src FROM m GROUP BY head")
def k3_cluster_weighted(spark: SparkSession, sf: str) -> DataFrame:
    d = views.detections(spark, sf, keep=True).withColumns({c: F.col("score") for c in ("con_sem", "con_pv", "con_weight")})
    c = fusion.clusters(d, 0.2)
    src = F.split("src", ";")
    return c.select("head", "n", F.round("con_weight", 9).alias("con_weight"), F.size(src).cast("long").alias("sources"), F.element_at(src, 1).alias("first_src"))


MERGE = views.sql("det", "ortho") + f", i AS (SELECT part AS module, k.seq AS seq, -k.score AS score, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM ({greedy_fold('det', 'module', '0.2e0')})), t AS (SELECT b.seq AS o, a.seq AS i, a.score AS si, b.score AS so FROM i a JOIN ortho b ON a.module = b.seq AND {IOU} > 0.2e0)"


@query(MERGE + " SELECT CASE WHEN t.so > t.si THEN 'ortho' ELSE 'image' END AS source, CASE WHEN t.so > t.si THEN t.o ELSE i.seq END AS seq, CASE WHEN t.so > t.si THEN 'replaced' ELSE 'kept' END AS outcome FROM i LEFT JOIN t ON t.i = i.seq UNION ALL SELECT 'ortho', seq, 'added' FROM ortho WHERE seq NOT IN (SELECT o FROM t)")
def k6_dom_confidence(spark: SparkSession, sf: str) -> DataFrame:
    i = fusion.suppressed(views.detections(spark, sf, keep=True), 0.2)
    return fusion.merge_sources(i, views.ortho(spark, sf), "confidence", 0.2).select("source", "seq", "outcome")


@query(MERGE + " SELECT CASE WHEN t.o IS NOT NULL THEN 'ortho' ELSE 'image' END AS source, coalesce(t.o, i.seq) AS seq, CASE WHEN t.o IS NOT NULL THEN 'replaced' ELSE 'kept' END AS outcome FROM i LEFT JOIN t ON t.i = i.seq UNION ALL SELECT 'ortho', seq, 'added' FROM ortho WHERE seq NOT IN (SELECT o FROM t)")
def k6_dom_prefer(spark: SparkSession, sf: str) -> DataFrame:
    i = fusion.suppressed(views.detections(spark, sf, keep=True), 0.2)
    return fusion.merge_sources(i, views.ortho(spark, sf), "prefer", 0.2).select("source", "seq", "outcome")


@query(MERGE + " SELECT 'image' AS source, seq, 'kept' AS outcome FROM i UNION ALL SELECT 'ortho', seq, 'added' FROM ortho")
def k6_dom_union(spark: SparkSession, sf: str) -> DataFrame:
    i = fusion.suppressed(views.detections(spark, sf, keep=True), 0.2)
    return fusion.merge_sources(i, views.ortho(spark, sf), "union", 0.2).select("source", "seq", "outcome")


# components by module: inside one module every two sightings overlap by more than 0.1, across modules none does by 0.2
@query(views.sql("det") + " SELECT min(seq) AS root, count(*) AS n FROM det GROUP BY module")
def k7_components(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.view_groups(views.detections(spark, sf, keep=True), 0.2).groupBy("root").agg(F.count("*").alias("n"))


DRAW = "((((seq + 42) * 48271) % 2147483647) * 16807 + 11) % 2147483647"


@query(views.sql("det") + f" SELECT root, seq FROM (SELECT seq, min(seq) OVER (PARTITION BY module) AS root, row_number() OVER (PARTITION BY module ORDER BY {DRAW}, seq) AS k FROM det) WHERE k <= 5")
def l2_view_sample(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.view_sample(views.detections(spark, sf, keep=True), 5, 0.2).select("root", "seq")


# ---- votes

@query(views.sql("det") + ", c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det), q AS (SELECT quantile_cont(cx, 0.25) AS a, quantile_cont(cx, 0.75) AS b, quantile_cont(cy, 0.25) AS c, quantile_cont(cy, 0.75) AS d FROM c) SELECT min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM c, q WHERE cx BETWEEN a - 0.4e0 * greatest(b - a, 1e0) AND b + 0.4e0 * greatest(b - a, 1e0) AND cy BETWEEN c - 0.4e0 * greatest(d - c, 1e0) AND d + 0.4e0 * greatest(d - c, 1e0)")
def a5_robust_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return votes.bounds_frame(views.detections(spark, sf, keep=True), 0.4)


GRID = votes.Grid(-2.0, 60.0, 300, 160, 0.5)
CELLS = "(SELECT score, unnest(generate_series(greatest(CAST(ceil((x1 + 2e0) / 0.5e0 - 0.5e0) AS BIGINT), 0), least(CAST(ceil((x2 + 2e0) / 0.5e0 - 0.5e0) AS BIGINT) - 1, 299))) AS c, greatest(CAST(ceil((60e0 - y2) / 0.5e0 - 0.5e0) AS BIGINT), 0) AS r0, least(CAST(ceil((60e0 - y1) / 0.5e0 - 0.5e0) AS BIGINT) - 1, 159) AS r1 FROM det)"
VOTES = f", cells AS (SELECT score, c, unnest(generate_series(r0, r1)) AS r FROM {CELLS}), v AS (SELECT r, c, count(*) AS votes FROM cells GROUP BY r, c)"


@query(views.sql("det") + VOTES + " SELECT r, c, CAST(votes AS DOUBLE) AS votes FROM v")
def a6_votes(spark: SparkSession, sf: str) -> DataFrame:
    return votes.cell_votes(views.detections(spark, sf), GRID)


@query(views.sql("det") + VOTES + ", m AS (SELECT r, c FROM v WHERE votes >= 2), k AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS k FROM m) SELECT CAST(r AS BIGINT) AS r, CAST(min(c) AS BIGINT) AS c0, CAST(max(c) AS BIGINT) AS c1 FROM k GROUP BY r, k")
def r3_mask_runs(spark: SparkSession, sf: str) -> DataFrame:
    return votes.runs_of(votes.cell_votes(views.detections(spark, sf), GRID).where("votes >= 2"))


@query()
def r3_vote_instances(spark: SparkSession, sf: str) -> DataFrame:
    v = votes.cell_votes(views.detections(spark, sf), GRID)
    return votes.instances(v, GRID, 27, 0.5).select("root", "cells", "area")


@query()
def r1_pixel_vote(spark: SparkSession, sf: str) -> DataFrame:
    return votes.pixel_vote(views.detections(spark, sf, keep=True), 0.2, 24, min_area=0.3).select("root", "cells", F.round("area", 6).alias("area"), "score")


# ---- evaluation

# an aligned sighting reaches IoU 0.5 with its own module only, so the first by score takes it
TP = ", e AS (SELECT a.seq, a.score, b.gt, " + IOU + " AS iou, " + INTER + " AS inter, " + AREA.format("a") + " AS pa, " + AREA.format("b") + " AS ga FROM det a JOIN gt b ON a.module = b.gt), thr AS (SELECT unnest({thr}) AS thr), m AS (SELECT * FROM (SELECT thr, e.*, row_number() OVER (PARTITION BY thr, gt ORDER BY score DESC, seq) AS k FROM e JOIN thr ON iou >= thr) WHERE k = 1)"


def listed(t) -> str:
    return "[" + ", ".join(f"{x!r}e0" for x in t) + "]"


@query(views.sql("det", "gt") + TP.format(thr=listed((0.5,))) + " SELECT thr, seq, gt, iou FROM m")
def k4_match_050(spark: SparkSession, sf: str) -> DataFrame:
    p = ev.overlap_pairs(views.detections(spark, sf), views.truth(spark, sf))
    return ev.matched(p, (0.5,), also=()).select("thr", "seq", "gt", "iou")


PRF = ", n AS (SELECT (SELECT count(*) FROM det) AS p, (SELECT count(*) FROM gt) AS g), t AS (SELECT thr, (SELECT count(*) FROM m WHERE m.thr = thr.thr) AS tp FROM thr) SELECT thr, tp, p - tp AS fp, g - tp AS fn, tp / p AS precision, tp / g AS recall, CASE WHEN tp > 0 THEN 2 * (tp / p) * (tp / g) / (tp / p + tp / g) ELSE 0e0 END AS f1 FROM t, n"


@query(views.sql("det", "gt") + TP.format(thr=listed(ev.THRESHOLDS)) + PRF)
def a7_prf(spark: SparkSession, sf: str) -> DataFrame:
    p, g = views.detections(spark, sf, keep=True), views.truth(spark, sf)
    return ev.counts(p, g, ev.matched(ev.overlap_pairs(p, g), ev.THRESHOLDS, also=()), ev.THRESHOLDS)


AP = ", n AS (SELECT count(*) AS g FROM gt), r AS (SELECT seq, row_number() OVER (ORDER BY score DESC, seq) AS place FROM det), h AS (SELECT thr, place, row_number() OVER (PARTITION BY thr ORDER BY place) AS tp FROM m JOIN r USING (seq)), v AS (SELECT thr, tp, max(tp / place) OVER (PARTITION BY thr ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM h), lv AS (SELECT unnest(generate_series(0, 100)) AS l), best AS (SELECT v.thr, lv.l, max(env) AS p FROM v, lv, n WHERE v.tp / n.g >= lv.l / 100e0 GROUP BY ALL), ap AS (SELECT thr.thr, round(coalesce(sum(p), 0e0) / 101e0, 9) AS ap FROM thr LEFT JOIN best USING (thr) GROUP BY thr.thr)"


@query(views.sql("det", "gt") + TP.format(thr=listed(ev.THRESHOLDS)) + AP + " SELECT thr, ap FROM ap")
def w3_ap_sweep(spark: SparkSession, sf: str) -> DataFrame:
    p, g = views.detections(spark, sf, keep=True), views.truth(spark, sf)
    m = ev.matched(ev.overlap_pairs(p, g), ev.THRESHOLDS, also=())
    return ev.average_precision(p, g.count(), m, ev.THRESHOLDS).select("thr", F.round("ap", 9).alias("ap"))


AJI = ", e AS (SELECT a.seq, b.gt, " + IOU + " AS iou, " + INTER + " AS inter FROM det a JOIN gt b ON a.module = b.gt), best AS (SELECT first(inter ORDER BY iou DESC, seq) AS inter FROM e WHERE iou > 0 GROUP BY gt)"


@query(views.sql("det", "gt") + AJI + f" SELECT round((SELECT sum(inter) FROM best) / ((SELECT sum({AREA.format('det')}) FROM det) + (SELECT sum({AREA.format('gt')}) FROM gt) - (SELECT sum(inter) FROM best)), 9) AS aji")
def k5_aji(spark: SparkSession, sf: str) -> DataFrame:
    p, g = views.detections(spark, sf, keep=True), views.truth(spark, sf)
    return ev.aji(p, g, ev.overlap_pairs(p, g)).select(F.round("aji", 9).alias("aji"))


@query(views.sql("drift", "gt_drift") + f", {tiles('d', 'drift')}, {tiles('g', 'gt_drift')}, e AS (SELECT a.seq, b.gt, {INTER} AS inter, {AREA.format('a')} AS pa, {AREA.format('b')} AS ga FROM d a JOIN g b ON {SAME_TILE} AND {OPEN}) SELECT (SELECT count(*) FROM (SELECT gt FROM e WHERE inter >= 0.5e0 * pa GROUP BY gt HAVING count(*) >= 2)) AS over_seg, (SELECT count(*) FROM (SELECT seq FROM e WHERE inter >= 0.5e0 * ga GROUP BY seq HAVING count(*) >= 2)) AS under_seg")
def a11_seg_errors(spark: SparkSession, sf: str) -> DataFrame:
    return ev.segmentation_errors(ev.overlap_pairs(views.detections(spark, sf, True), views.truth(spark, sf, True)))


@query(views.sql("det", "gt") + TP.format(thr=listed((0.5, 0.75))) + ", s AS (SELECT m.*, hypot((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2, (d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) AS ds, iou * (pa + ga) / (1 + iou) AS i FROM m JOIN det d USING (seq) JOIN gt g ON g.gt = m.gt) SELECT thr, round(avg(iou), 9) AS mean_iou, round(sum(i) / sum(pa + ga - i), 9) AS micro_iou, round(avg((pa - ga) * (pa - ga)), 9) AS area_mse, round(avg(abs(pa - ga)), 9) AS area_mae, round(sqrt(avg(ds * ds)), 9) AS centroid_rmse, round(avg(ds), 9) AS centroid_mae FROM s GROUP BY thr".replace("hypot(", "pythag(").replace("pythag((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2, (d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2)", "sqrt(((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) ** 2 + ((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) ** 2)"))
def a8_matched_stats(spark: SparkSession, sf: str) -> DataFrame:
    p, g = views.detections(spark, sf, keep=True), views.truth(spark, sf)
    s = ev.matched_stats(ev.matched(ev.overlap_pairs(p, g), (0.5, 0.75)), p, g)
    return s.select("thr", *[F.round(c, 9).alias(c) for c in s.columns if c != "thr"])


@query(views.sql("det", "gt") + TP.format(thr=listed(ev.THRESHOLDS)) + AP + ", s AS (SELECT (SELECT avg(ap) FROM ap WHERE thr IN " + str(ev.COCO) + ") AS map, (SELECT avg(ap) FROM ap WHERE thr IN " + str(ev.STRICT) + ") AS ap_high, (SELECT avg(iou) FROM m WHERE thr = 0.5) AS sq, (SELECT count(*) FROM m WHERE thr = 0.5) AS tp, (SELECT count(*) FROM det) AS p, (SELECT count(*) FROM gt) AS g) SELECT round(map, 6) AS map, round(ap_high, 6) AS ap_high, round(sq, 6) AS sq, round(2e0 * tp / (p + g), 6) AS rq, round(sq * 2e0 * tp / (p + g), 6) AS pq FROM s")
def a12_map_pq(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.summary(views.detections(spark, sf, keep=True), views.truth(spark, sf))
    return s.select(*[F.round(c, 6).alias(c) for c in ("map", "ap_high", "sq", "rq", "pq")])


