"""Detections against ground truth: matching, average precision, aggregated Jaccard, segmentation errors, scene areas.

Predictions hold seq, score and a box, ground truth gt and a box, both a segmentation ``seg`` where polygons count;
``groups`` (station, iteration, variant, ...) are columns of both.  The overlapping pairs are computed once and filtered by threshold; the threshold is a column of the
edges, so all matchings of a sweep run in the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import box_area, iou, overlap_area
from ..functions.polygons import could_overlap, pair_columns, shape_overlaps, with_shapes
from ..functions.rings import ring_centroid
from ..runtime import drop, materialize
from .greedy import greedy_matching
from .ordering import placed
from .tile_join import few_tile_pairs, meet, spread, tile_size

#: Thresholds of the usual sweep, and the strict ones (fixed values).
COCO = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
STRICT = (0.9, 0.95, 0.975)
THRESHOLDS = tuple(sorted({*COCO, *STRICT}))
#: Predictions with polygons that go through a join at a time, some 240 bytes each in the shuffle.
PASS = 9_000_000


def overlap_pairs(pred: DataFrame, gt: DataFrame, groups: list[str] | None = None, least: float = 0.0, also: tuple[str, ...] = ("inter", "p_area", "g_area"), each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(groups, seq, gt, score, iou, ``also``) of pairs that overlap by more than an edge; pairs with an IoU under ``least`` may be left out.

    More than PASS predictions with polygons go to the join in passes, each with its own tiles, and ``each`` is applied to
    the pairs of a pass before they are written: the shuffle holds the edges of one pass only.
    """
    groups = groups or []
    shapes = ["seg"] * ("seg" in pred.columns and "seg" in gt.columns)
    p = pred.select(*groups, "seq", F.coalesce("score", F.lit(0.0)).alias("score"), "x1", "y1", "x2", "y2", *shapes)
    g = gt.select(*groups, "gt", "x1", "y1", "x2", "y2", *shapes)
    tile = 1.25 * tile_size(g.select("x1", "y1", "x2", "y2"))
    area = lambda k: F.coalesce(f"{k}.area", box_area(k)) if shapes else box_area(k)
    own, areas = [*[F.col(f"a.{k}") for k in groups], "a.seq", "b.gt", "a.score"], [area("a").alias("p_area"), area("b").alias("g_area")]
    cols = [*groups, "seq", "gt", "score", "iou", *also]
    if not shapes:
        pairs = few_tile_pairs(p, g, tile, groups, False).select(*own, iou("a", "b").alias("iou"), overlap_area("a", "b").alias("inter"), *areas).select(*cols)
        return each(pairs) if each else pairs
    passes = max(1, -(-p.count() // PASS))
    a, b = spread(p, g, tile)
    done = []
    for k in range(passes):
        here = F.pmod(F.xxhash64("tx", "ty"), F.lit(passes)) == k
        one, two = (with_shapes(d.where(here) if passes > 1 else d).drop("seg") for d in (a, b))
        pairs = meet(one, two, groups, False).where(could_overlap("a", "b", least)).select(*own, *areas, *pair_columns())
        pairs = shape_overlaps(pairs).select(*cols)
        pairs = each(pairs) if each else pairs.where(F.col("iou") >= least)
        done.append(materialize(pairs, "pairs-pass") if passes > 1 else pairs)
    return reduce(DataFrame.unionByName, done)


def feature_area(f: DataFrame, keys: tuple[str, ...] = (), stored: str | None = None) -> DataFrame:
    """(keys, a): each feature's area: the ``stored`` column where it is positive, else its polygon's, else its box's."""
    box = F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))
    first = [F.when(F.col(stored) > 0, F.col(stored)).alias("_stored")] if stored else []
    cols = [*keys, "x1", "y1", "x2", "y2", *first]
    d = with_shapes(f.select(*cols, "seg")) if "seg" in f.columns else f.select(*cols)
    found = ([F.col("_stored")] if stored else []) + ([F.col("area")] if "seg" in f.columns else [])
    return d.select(*keys, F.coalesce(*found, box, F.lit(0.0)).alias("a"))


def labelled(f: DataFrame, label: int | None) -> DataFrame:
    """Only features of the label, if one is given; a missing label counts as 0."""
    return f if label is None else f.where(F.coalesce(F.col("label").cast("int"), F.lit(0)) == label)


def matched(pairs: DataFrame, thresholds: tuple[float, ...], groups: list[str] | None = None, also: tuple[str, ...] = ("inter", "p_area", "g_area")) -> DataFrame:
    """Greedy matching at each threshold (IoU at or above it): predictions by score take their best free ground truth, the last on ties.

    Where no prediction is the first by score at two ground truths, each ground truth goes to its first: a prediction
    then finds all others of its ground truths taken by those before it.  One window tells the first at every
    threshold, since in score order an edge is first at the thresholds that it reaches and none before it did.
    Otherwise the ground truths that share a prediction go through rounds, with all their edges.  ``also``: further
    columns of the pairs that the matches carry.
    """
    groups = groups or []
    ts = sorted({float(x) for x in thresholds})
    e = pairs.where(F.col("iou") >= ts[0])
    e = e.select(*groups, "seq", "gt", "iou", (-F.col("score")).alias("o1"), *also)
    reached = sum((F.col("iou") >= t).cast("int") for t in ts)
    by = W.partitionBy(*groups, "gt").orderBy("o1", "seq").rowsBetween(W.unboundedPreceding, -1)
    values = F.array(*[F.lit(t) for t in ts])
    cols = [*groups, "thr", "seq", "gt", "iou", *also]

    def firsts(d: DataFrame) -> DataFrame:
        d = d.withColumn("_k", reached).withColumn("_before", F.coalesce(F.max("_k").over(by), F.lit(0))).where("_k > _before")
        return d.withColumn("thr", F.explode(F.slice(values, F.col("_before") + 1, F.col("_k") - F.col("_before")))).select(*cols)

    first = materialize(firsts(e), "matched")
    twice = first.groupBy(*groups, "thr", "seq").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.head(1):
        return first
    drop(first)
    e = materialize(e, "match-edges")
    several = e.groupBy(*groups, "seq").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(e.join(several, [*groups, "seq"], "left_semi").select(*groups, "gt").distinct(), "match-shared")
    hard = e.join(shared, [*groups, "gt"], "left_semi").withColumn("thr", F.explode(values)).where(F.col("iou") >= F.col("thr"))
    hard = hard.withColumns({"o2": -F.col("iou"), "o3": -F.col("gt")})
    hard = greedy_matching(hard, [*groups, "thr", "seq"], [*groups, "thr", "gt"], ["o1", "seq", "o2", "o3"]).select(*cols)
    return firsts(e.join(shared, [*groups, "gt"], "left_anti")).unionByName(hard)


def counts(pred: DataFrame, gt: DataFrame, match: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(thr, tp, fp, fn, precision, recall, f1); ratios are 0 where they have no base, and fn counts all ground truth without predictions."""
    spark = pred.sparkSession
    base = spark.createDataFrame([(float(t),) for t in thresholds], "thr double")
    tp = match.groupBy("thr").agg(F.count("*").alias("tp"))
    n = pred.agg(F.count("*").alias("n_pred")).join(gt.agg(F.count("*").alias("n_gt")))  # two single rows
    out = base.join(tp, "thr", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).join(F.broadcast(n))
    out = out.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    out = out.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1).select("thr", "tp", "fp", "fn", "precision", "recall", "f1")


def ratio(top, bottom):
    top = F.col(top) if isinstance(top, str) else top
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def average_precision(pred: DataFrame, n_gt: int, match: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(thr, ap): mean over 101 recall levels of the best precision at that recall or more.

    Precision only changes the answer where recall rises, so only matched predictions need their place in the score
    order: one shared ranking, then running counts over the matches.  The envelope at recall r is the largest
    precision among later matches.  Without ground truth ap is 1 if there are no predictions, else 0.
    """
    spark = pred.sparkSession
    base = spark.createDataFrame([(float(t),) for t in thresholds], "thr double")
    n_pred = pred.count() if n_gt == 0 else 1
    if n_gt == 0 or n_pred == 0:
        return base.withColumn("ap", F.lit(1.0 if n_gt == 0 and n_pred == 0 else 0.0))
    place = placed(pred.select("seq", F.coalesce("score", F.lit(0.0)).alias("score")), [F.desc("score"), F.asc("seq")]).select("seq", "place")
    hit = match.select("thr", "seq").join(place, "seq")
    by = W.partitionBy("thr").orderBy("place")
    hit = hit.withColumn("tp", F.row_number().over(by)).withColumn("precision", F.col("tp") / F.col("place"))
    later = W.partitionBy("thr").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = hit.withColumn("env", F.max("precision").over(later))  # a running maximum from the end
    # match number tp answers the levels r above recall (tp - 1) / n up to tp / n, in whole numbers
    upto = lambda tp: (100 * tp - F.pmod(100 * tp, F.lit(n_gt))) / F.lit(n_gt)
    levels = upto(F.col("tp")) - upto(F.col("tp") - 1) + F.when(F.col("tp") == 1, 1).otherwise(0)
    ap = hit.groupBy("thr").agg((F.sum(F.col("env") * levels) / F.lit(101.0)).alias("ap"))
    return base.join(ap, "thr", "left").select("thr", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _best_of_truth(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Of each ground truth its pair of largest IoU above 0, the first on ties."""
    best = F.min(F.struct((-F.col("iou")).alias("o"), *[c for c in pairs.columns if c not in (*groups, "gt")])).alias("best")
    return pairs.where("iou > 0").groupBy(*groups, "gt").agg(best).select(*groups, "gt", "best.*").drop("o").select(*pairs.columns)


def aji_matches(pairs: DataFrame | Callable[[], DataFrame], groups: list[str] | None = None, best: DataFrame | None = None) -> DataFrame:
    """Ground truth in order takes its free prediction of largest IoU above 0, the first on ties.  ``best``: pairs that hold each ground truth's best, if they are known."""
    groups = groups or []
    # if no prediction is the best of two ground truths, each takes its best; otherwise rounds
    first = materialize(_best_of_truth(pairs if best is None else best, groups), "aji")
    if not first.groupBy(*groups, "seq").agg(F.count("*").alias("n")).where("n > 1").head(1):
        return first
    drop(first)
    pairs = pairs() if callable(pairs) else pairs
    return greedy_matching(pairs.where("iou > 0").withColumn("o", -F.col("iou")), [*groups, "gt"], [*groups, "seq"], ["gt", "o", "seq"]).drop("o")


def aji(pred: DataFrame, gt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: aji = common area over union area, where unmatched ground truth and unused predictions count whole; 0 without ground truth.

    Without ``pairs`` they are found here, and of each pass only the best of each ground truth is written.
    """
    cols = ["seq", "gt", "iou", "inter"]
    if pairs is None:
        best = overlap_pairs(pred, gt, also=("inter",), each=lambda d: _best_of_truth(d.select(*cols), []))
        m = aji_matches(lambda: overlap_pairs(pred, gt, also=("inter",)).select(*cols), best=best)
    else:
        m = aji_matches(pairs.select(*cols))
    m = m.agg(F.coalesce(F.sum("inter"), F.lit(0.0)).alias("inter"))
    total = lambda f, n: feature_area(f).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias(n))
    one = m.join(total(pred, "p")).join(total(gt, "g"))  # three single rows
    union = F.col("p") + F.col("g") - F.col("inter")
    return one.select(F.when((union > 0) & (F.col("g") > 0), F.col("inter") / union).otherwise(F.lit(0.0)).alias("aji"))


def segmentation_errors(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: over = ground truths that hold two predictions or more, under = predictions that hold two ground truths or more.

    Holding: common area at least ``least`` of the held one.
    """
    many = lambda col, held: pairs.where(F.col("inter") >= least * F.col(held)).groupBy(col).count().where("count >= 2").agg(F.count("*"))
    over = many("gt", "p_area").toDF("over_seg")
    return over.join(many("seq", "g_area").toDF("under_seg"))


def matched_stats(match: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Per threshold over matched pairs: mean and micro IoU, area errors, centroid errors."""
    def c(f, k, p):
        box = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
        at = F.coalesce(ring_centroid(F.element_at("seg", 1)), box) if "seg" in f.columns else box
        return f.select(F.col(k), at["x"].alias(f"{p}x"), at["y"].alias(f"{p}y"))

    m = match.join(c(pred, "seq", "p"), "seq").join(c(gt, "gt", "g"), "gt")
    m = m.withColumn("d", F.hypot(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"))).withColumn("da", F.col("p_area") - F.col("g_area"))
    inter = F.col("iou") * (F.col("p_area") + F.col("g_area")) / (1 + F.col("iou"))
    m = m.withColumn("i", inter)
    micro = F.sum("i") / F.sum(F.col("p_area") + F.col("g_area") - F.col("i"))
    return m.groupBy("thr").agg(F.avg("iou").alias("mean_iou"), micro.alias("micro_iou"), F.avg(F.col("da") * F.col("da")).alias("area_mse"), F.avg(F.abs("da")).alias("area_mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("centroid_rmse"), F.avg("d").alias("centroid_mae"))


def summary(pred: DataFrame, gt: DataFrame, primary: float = 0.5, thresholds: tuple[float, ...] = THRESHOLDS, label: int | None = None) -> DataFrame:
    """One row of headline numbers: f1, precision, recall, sq, rq, pq, map, ap_high, ap50, ap95, aji, over, under; of one ``label`` if it is given."""
    pred, gt = labelled(pred, label), labelled(gt, label)
    pairs = materialize(overlap_pairs(pred, gt), "pairs")
    m = materialize(matched(pairs, tuple(sorted({*thresholds, primary})), also=()), "matches")
    n_gt = gt.count()
    ap = average_precision(pred, n_gt, m, thresholds)
    mean = lambda keep, n: F.avg(F.when(F.col("thr").isin([float(x) for x in keep]), F.col("ap"))).alias(n)
    ap = ap.agg(mean(COCO, "map"), mean(STRICT, "ap_high"), mean((0.5,), "ap50"), mean((0.95,), "ap95"))
    c = counts(pred, gt, m, (primary,)).drop("thr")
    sq = m.where(F.col("thr") == primary).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("sq"))
    out = c.join(sq).join(ap).join(aji(pred, gt, pairs)).join(segmentation_errors(pairs))  # single rows
    return out.withColumn("rq", F.col("f1")).withColumn("pq", F.col("sq") * F.col("f1"))
