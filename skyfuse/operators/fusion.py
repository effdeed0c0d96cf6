"""Fusing detections of many views: suppression, merging, clustering, cross-source merge, view sampling.

Features come as DataFrames with seq (unique), score and x1..y2; a higher score ranks first, ties go to the smaller
seq.  With a segmentation in ``seg`` their overlaps are those of the polygons, without one those of the boxes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import box_ring, iou, over_smaller, overlaps
from ..functions.polygons import could_overlap, pair_columns, shape_overlaps, union_area, with_shapes
from ..runtime import cheap, drop, materialize
from .block_scan import FIRST, GONE, LOST, OPEN, scanner
from .components import components
from .tile_join import few_tile_pairs, near_pairs, spread, tile_pairs, tile_size, tiled
from .votes import pixel_vote

FUSED_FLOOR = 1e-6
#: Rows with polygons that go through a scan's shuffle at a time, some 200 bytes each; rows of a block at most, as a mean.
PASS, BLOCK_ROWS = 6_000_000, 100_000
#: Scans by blocks before what is open goes on in rounds over pairs.
SCANS = 3


def _slim(f: DataFrame, keys: list[str]) -> DataFrame:
    s = f.select("seq", F.coalesce("score", F.lit(0.0)).alias("score"), "x1", "y1", "x2", "y2", *keys, *(["seg"] if "seg" in f.columns else []))
    return with_shapes(s).drop("seg") if "seg" in f.columns else s


def _over(pairs: DataFrame, threshold: float, cols: list[Column], smaller: bool = False) -> DataFrame:
    """``cols`` of the pairs (a, b) of slim rows whose boxes meet and that overlap by more than the threshold: polygons where there are any, else boxes."""
    if "edge" not in pairs.columns:
        return pairs.where((over_smaller if smaller else iou)("a", "b") > F.lit(float(threshold))).select(*cols)
    d = shape_overlaps(pairs.where(could_overlap("a", "b", threshold, smaller)).select(*cols, *pair_columns()))
    return d.where(F.col("ios" if smaller else "iou") > F.lit(float(threshold))).drop("iou", "ios", "inter")


def _meeting(a: DataFrame, b: DataFrame, tile: float, keys: list[str], threshold: float, smaller: bool, also: Column | None = None) -> DataFrame:
    """seq of the rows of ``a`` that overlap one of ``b``.  Boxes are semi-joined, which stops at a row's first match; polygons stream past the kernel.  Without ``also``, ``b`` has few rows.  No pair is written."""
    if "edge" in a.columns:
        pairs = few_tile_pairs(a, b, 1.25 * tile, keys) if also is None else tile_pairs(a, b, tile, keys, True, also)
        return _over(pairs, threshold, [F.col("a.seq").alias("seq")], smaller).distinct()
    also = F.lit(True) if also is None else also
    on = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    on &= overlaps("a", "b") & ((over_smaller if smaller else iou)("a", "b") > F.lit(float(threshold))) & also
    return tiled(a, tile).alias("a").join(tiled(b, tile).alias("b"), on, "left_semi").select("seq").distinct()


def _before(a: str, b: str) -> Column:
    return (F.col(f"{a}.score") > F.col(f"{b}.score")) | ((F.col(f"{a}.score") == F.col(f"{b}.score")) & (F.col(f"{a}.seq") < F.col(f"{b}.seq")))


def _surely_first(s: DataFrame, threshold: float, keys: list[str], tile: float, smaller: bool) -> DataFrame:
    """seq of rows that no better row can overlap, by boxes, boxes at 45 degrees and areas: of the best of small cells, those without such a row.

    The best row is always one.  Only the best of cells go to several tiles, and the join stops at a row's first match.
    """
    cols = s.select("seq", "score", "x1", "y1", "x2", "y2", *keys, "area", "u1", "u2", "v1", "v2")
    cell = [*keys, "_cx", "_cy"]
    n = lambda c, side: F.floor(F.col(c) / F.lit(float(side)))
    small = cols.withColumns({"_cx": n("x1", tile / 4), "_cy": n("y1", tile / 4)})
    best = small.groupBy(*cell).agg(F.max("score").alias("score"))
    top = small.join(best.hint("merge"), [*cell, "score"], "left_semi").drop("_cx", "_cy")
    few, many = spread(cols, top, 1.25 * tile)
    on = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    on &= overlaps("a", "b") & _before("a", "b") & could_overlap("a", "b", threshold, smaller)
    beaten = many.alias("b").join(few.alias("a").hint("merge"), on, "left_semi").select("seq").distinct()
    return top.select("seq").join(beaten, "seq", "left_anti")


def first_ranked(s: DataFrame, threshold: float, keys: list[str], tile: float, smaller: bool = False, most_rounds: int = 500) -> DataFrame:
    """The rows that a scan by rank keeps, of slim rows (seq, score, box, keys).

    A round keeps the open rows that no better open row overlaps, and drops what those overlap.  Rows of a dense
    cluster are gone after one round.  With polygons, a first round keeps rows that columns tell to have no better
    one, so that a cluster's rows meet its kept row in the kernel, not each other.
    """
    open_, out = s, []
    for k in range(most_rounds):
        if not open_.head(1):
            break
        if k == 0 and "edge" in s.columns:
            sure = _surely_first(open_, threshold, keys, tile, smaller).checkpoint()
            kept = open_.join(sure, "seq", "left_semi").checkpoint()
            rest = open_.join(sure, "seq", "left_anti")
        else:
            beaten = _meeting(open_, open_, tile, keys, threshold, smaller, _before("b", "a")).checkpoint()
            kept = open_.join(beaten, "seq", "left_anti").checkpoint()
            rest = open_.join(beaten, "seq", "left_semi")
        out.append(kept)
        lost = _meeting(rest, kept, tile, keys, threshold, smaller)
        open_ = rest.join(lost, "seq", "left_anti").checkpoint()
    else:
        raise RuntimeError("selection did not end")
    return reduce(DataFrame.unionByName, out) if out else s.limit(0)


def _block_side(f: DataFrame, tile: float) -> tuple[int, int]:
    """(rows, tiles along a block's side): by the mean of the parts of 8 x 8 tiles that hold rows."""
    n = lambda c: F.floor(F.col(c) / F.lit(8 * tile))
    got = f.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(n("x1"), n("y1"))).alias("parts")).first()
    most = min(BLOCK_ROWS, max(10_000, got["n"] // (4 * f.sparkSession.sparkContext.defaultParallelism)))
    return got["n"], 8 * max(1, min(16, int((most * max(got["parts"], 1) / max(got["n"], 1)) ** 0.5)))


def _scanned(rows: DataFrame, cols: list[str], keys: list[str], tile: float, side: int, off: tuple[int, int], threshold: float, smaller: bool, heads: bool, part: tuple[int, int]) -> DataFrame:
    """A scan of the blocks of one ``part`` (number, of how many)."""
    low = lambda a, b, o: F.floor((F.floor(F.least(a, b) / F.lit(tile)) + o) / side).cast("long")
    high = lambda a, b, o: F.floor((F.floor(F.greatest(a, b) / F.lit(tile)) + o) / side).cast("long")
    d = rows.withColumn("_bx", F.explode(F.sequence(low("x1", "x2", off[0]), high("x1", "x2", off[0])))).withColumn("_by", F.explode(F.sequence(low("y1", "y2", off[1]), high("y1", "y2", off[1]))))
    if part[1] > 1:
        d = d.where(F.pmod(F.xxhash64("_bx", "_by", *keys), F.lit(part[1])) == part[0])
    group = ["_bx", "_by", *keys]
    d = d.repartition(*group).sortWithinPartitions(*group, F.coalesce("score", F.lit(0.0)).desc(), "seq")
    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols), "_code int", "_head long", "_home boolean"])
    return d.mapInArrow(scanner(d.columns, cols, keys, off, threshold, smaller, tile, side, heads), kinds)


def _polygon_groups(f: DataFrame, threshold: float, keys: list[str], smaller: bool = False, each: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(kept rows of f, ``each`` of parts of all rows with head); without ``each`` no heads are sought.

    Blocks of the map are scanned by rank, PASS rows at a time, so that the shuffle holds those only.  What a block
    can't tell, as its neighbours decide it, goes to blocks that lie otherwise, and what is open then to rounds over
    pairs.  Parts of ``each`` hold columns of f, ``seg`` but for kept rows only where a row went through the rounds.
    """
    f = f if cheap(f) else materialize(f, "nms-rows")
    cols, heads = f.columns, each is not None
    tile = tile_size(f)
    n, side = _block_side(f, tile)
    apart = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("x1", "y1", "x2", "y2", *keys)])
    alone = f.where(apart)  # they overlap nothing
    kept, told = [alone], [each(alone.withColumn("head", F.col("seq")))] if heads else []
    rows = f.where(~apart).withColumn("_state", F.lit(OPEN))
    open_ = lost = None
    for k in range(SCANS):
        off = (side * k // SCANS, side * ((2 * k) % SCANS) // SCANS)
        passes, live = max(1, -(-n // PASS)), []
        for p in range(passes):
            out = _scanned(rows, cols, keys, tile, side, off, threshold, smaller, heads, (p, passes))
            if heads:
                every = materialize(out.withColumn("seg", F.when(F.col("_code") != GONE, F.col("seg"))), "scan-rows")
                done = every.where(F.col("_code").isin(FIRST, GONE)).withColumn("head", F.col("_head"))
                told.append(materialize(each(done.select(*cols, "head")), "scan-told"))
                live.append(materialize(every.where(F.col("_code") != GONE).drop("_head"), "scan-live"))
                drop(every)
            else:
                live.append(materialize(out.where(F.col("_code") != GONE).drop("_head"), "scan-live"))
        live = reduce(DataFrame.unionByName, live)
        kept.append(live.where(F.col("_code") == FIRST).select(*cols))
        # a row is open if no copy of it was dropped
        hit = live.where((F.col("_code") == LOST) & ~F.col("_home")).select("seq", F.lit(LOST).alias("_hit")).distinct()
        rest = live.where(F.col("_home") & (F.col("_code") != FIRST)).join(hit, "seq", "left").withColumn("_state", F.coalesce("_hit", "_code"))
        rest = materialize((rest if heads else rest.where(F.col("_state") == OPEN)).select(*cols, "_state"), "scan-rest")
        open_, lost = (rest.where(F.col("_state") == s).select(*cols) for s in (OPEN, LOST))
        if not rest.head(1):
            return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, told) if heads else None
        stays = reduce(DataFrame.unionByName, kept[1:]).withColumn("_state", F.lit(FIRST))
        rows = rest.unionByName(stays)
        n = rows.count()
    if open_.head(1):
        first = materialize(first_ranked(materialize(_slim(open_, keys), "nms-rows"), threshold, keys, tile, smaller).select("seq"), "nms-first")
        more = materialize(open_.join(first, "seq", "left_semi").select(*cols), "nms-kept")
        kept.append(more)
        if heads:
            told.append(each(more.withColumn("head", F.col("seq"))))
            lost = lost.unionByName(open_.join(first, "seq", "left_anti").select(*cols))
    every = reduce(DataFrame.unionByName, kept)
    if heads and lost.head(1):
        pairs = few_tile_pairs(_slim(lost, keys), _slim(every, keys), 1.25 * tile, keys)
        told.append(each(lost.join(_heads(pairs, threshold, smaller), "seq")))
    return every, reduce(DataFrame.unionByName, told) if heads else None


def _heads(pairs: DataFrame, threshold: float, smaller: bool) -> DataFrame:
    """(seq, head): the first-ranked row b of the pairs that each row a overlaps."""
    near = _over(pairs, threshold, [F.col("a.seq").alias("seq"), F.col("b.score").alias("s"), F.col("b.seq").alias("h")], smaller)
    # the best score, then of equal ones the first: two plain aggregates
    best = near.groupBy("seq").agg(F.max("s").alias("s"))
    return near.join(best, ["seq", "s"]).groupBy("seq").agg(F.min("h").alias("head"))


def suppressed(f: DataFrame, threshold: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """Non-maximum suppression: rows kept when those that overlap a kept, better row by more than ``threshold`` go.

    ``keys`` such as the image restrict it to rows with equal keys.  Rows with a missing score rank as 0.
    """
    keys = keys or []
    if "seg" in f.columns:
        return _polygon_groups(f, threshold, keys)[0]
    s = materialize(_slim(f, keys), "nms-rows")
    kept = first_ranked(s, threshold, keys, tile_size(s))
    return f.join(kept.select("seq"), "seq", "left_semi")


def grouped(f: DataFrame, threshold: float, smaller: bool, each: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows that hold the kept ones of f, ``each`` of parts of f with head): head is the seq of the first-ranked kept row that each row falls to (its own, if kept), by IoU or by the common part of the ``smaller``."""
    if "seg" in f.columns:
        return _polygon_groups(f, threshold, [], smaller, each)
    s = materialize(_slim(f, []), "nms-rows")
    tile = tile_size(s)
    kept = first_ranked(s, threshold, [], tile, smaller).checkpoint()
    rest = s.join(kept.select("seq"), "seq", "left_anti")
    head = _heads(tile_pairs(rest, kept, tile), threshold, smaller)
    return f, each(f.join(head, "seq", "left").withColumn("head", F.coalesce("head", "seq")))


def merged_groups(f: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Non-maximum merging: (head, n, score, x1..y2 of the union): a head takes all rows with over-smaller above the threshold and keeps its attributes."""
    box = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    score = F.max(F.when(F.col("seq") == F.col("head"), F.col("score"))).alias("score")
    parts = grouped(f, threshold, True, lambda g: g.groupBy("head").agg(F.count("*").alias("n"), score, *box))[1]
    return parts.groupBy("head").agg(F.sum("n").alias("n"), F.max("score").alias("score"), *box)


def union_areas(f: DataFrame, key: str) -> DataFrame:
    """(key, n, area): what the polygons of each group cover together; those that aren't valid are skipped.  A group's distinct polygons are one task's."""

    def cover(pdf):
        import pandas as pd

        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["n"].sum()), union_area(pdf["seg"]))], columns=[key, "n", "area"])

    kind = f.schema[key].dataType.simpleString()
    return f.groupBy(key, "seg").agg(F.count("*").alias("n")).groupBy(key).applyInPandas(cover, f"{key} {kind}, n long, area double")


def weighted_mean(value: Column, weight: Column) -> Column:
    w = F.greatest(weight, F.lit(FUSED_FLOOR))
    return F.sum(value * w) / F.sum(w)


def clusters(f: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Clusters by overlap with the head: the heads' rows with head, n, con_sem, con_pv, con_weight (means weighted by score), score and src (sources joined)."""
    means = ("con_sem", "con_pv", "con_weight")
    w = F.greatest(F.col("score"), F.lit(FUSED_FLOOR))
    sums = [F.sum(F.col(c) * w).alias(c) for c in means]
    rows, parts = grouped(f, threshold, False, lambda g: g.groupBy("head").agg(F.count("*").alias("n"), *sums, F.sum(w).alias("_w"), F.collect_set("src").alias("src")))
    srcs = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("src")))), ";").alias("src")
    out = parts.groupBy("head").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("_w")).alias(c) for c in means], srcs)
    own = rows.drop("head", *out.columns, "score").withColumnRenamed("seq", "head")
    return out.withColumn("score", F.col("con_weight")).join(own, "head").withColumn("seq", F.col("head"))


def fused(f: DataFrame, method: str = "nms_keep_max", threshold: float = 0.2, extra: DataFrame | None = None, vote: dict | None = None) -> DataFrame:
    """Multi-view fusion by name; ``extra`` is a second source that votes too, ``vote`` the options of ``votes.pixel_vote``."""
    if method == "nms_keep_max":
        return suppressed(f, threshold)
    if method == "cluster_weighted":
        return clusters(f, threshold)
    if method == "pixel_vote":
        cols = ["score", "x1", "y1", "x2", "y2"] + ["seg"] * ("seg" in f.columns)
        rows = f.select(*cols) if extra is None else f.select(*cols).unionByName(extra.select(*[c for c in cols if c in extra.columns]), allowMissingColumns=True)
        out = pixel_vote(rows, **(vote or {}))
        return out.withColumns({"seq": F.col("root"), "src": F.lit("pixel_vote"), "seg": F.array(box_ring())})
    raise ValueError(f"unknown fusion method {method!r}")


def merge_sources(image: DataFrame, ortho: DataFrame, strategy: str = "confidence", threshold: float = 0.2) -> DataFrame:
    """Merge a second source into fused features: (source, seq, score, x1..y2, seg and src if both have them, outcome).

    Second-source rows come in seq order.  Each looks for its best candidate by score (first place on ties) with IoU
    above the threshold among what is merged so far, earlier second-source rows included.  Without one, or under
    'union', it is appended; 'prefer' replaces the candidate, 'confidence' replaces it if the score is strictly
    greater.  A row whose candidates are nobody else's is decided in columns.  The others are scanned in order,
    component by component of what overlaps; a component's scan is one task's, with its rows and their neighbours in
    memory.  An unknown strategy is an error where an overlap is found.
    """
    keep = ("seq", "score", "x1", "y1", "x2", "y2")
    shapes = "seg" in image.columns and "seg" in ortho.columns
    also = [c for c in ("seg", "src") if c in image.columns and c in ortho.columns]
    image, ortho = (x.select(*keep, *also).withColumn("side", F.lit(k)) for k, x in enumerate((image, ortho)))
    both = image.unionByName(ortho).withColumn("node", F.col("seq") * 2 + F.col("side"))
    every = materialize(with_shapes(both) if shapes else both, "merge-rows")
    say = lambda d, outcome: d.select(F.when(F.col("side") == 1, "ortho").otherwise("image").alias("source"), *keep, *also, outcome.alias("outcome"))
    as_is = F.when(F.col("side") == 1, "added").otherwise("kept")
    if strategy == "union":
        return say(every, as_is)
    pairs = tile_pairs(every, every.where("side = 1"), tile_size(every), None, True, F.col("a.node") != F.col("b.node"))
    near = _over(pairs, threshold, [F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.side").alias("side"), F.col("a.score").alias("score")])
    near = materialize(near, "merge-near")
    if strategy not in ("prefer", "confidence") and near.head(1):
        raise ValueError(f"unknown merge strategy {strategy!r}")
    # contested: with an earlier or later row of its own source, or with a candidate that another row has too
    shared = near.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    fought = near.join(shared, "a", "left_semi").select("b").unionByName(near.where("side = 1").select("b")).distinct()
    plain = near.join(fought, "b", "left_anti").join(every.where("side = 1").select(F.col("node").alias("b"), F.col("score").alias("mine")), "b")
    best = plain.groupBy("b", "mine").agg(F.max("score").alias("score"), F.max_by("a", F.struct("score", -F.col("a"))).alias("a"))
    wins = F.lit(True) if strategy == "prefer" else F.col("mine") > F.col("score")
    best = materialize(best.select("a", "b", wins.alias("wins")), "merge-plain")
    edges = near.join(fought, "b", "left_semi").select("a", "b")
    parts = components(edges)
    # a row is out if it was replaced, or didn't replace its candidate
    told = best.select(F.col("a").alias("node"), F.when(F.col("wins"), "gone").alias("told")).unionByName(best.select(F.col("b").alias("node"), F.when(F.col("wins"), "replaced").otherwise("gone").alias("told"))).where("told is not null")
    simple = every.join(parts.select("node"), "node", "left_anti").join(told, "node", "left").where("told is null or told <> 'gone'")
    simple = say(simple, F.coalesce("told", as_is))
    rows = every.select("node", "side", "score", *[c for c in keep if c != "score"]).join(parts, "node")
    to = edges.groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("near"))
    rows = rows.join(to, "node", "left").select("root", "side", "seq", "node", "score", "near")
    rows = rows.repartition("root").sortWithinPartitions("root", "side", "seq")

    def scan(batches):
        import pyarrow as pa

        now, taker, places, out = None, {}, 0, []  # taker: node -> (place, score, outcome) of what is merged now
        for batch in batches:
            for root, side, seq, node, score, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != now:
                    out += [(n, o) for n, (_, _, o) in taker.items()]
                    now, taker, places = root, {}, 0
                here = [(taker[n][1], -taker[n][0], n) for n in to or () if n in taker] if side else []
                if not here:
                    taker[node], places = (places, score, "added" if side else "kept"), places + 1
                    continue
                top, place, mate = max(here)
                if strategy == "prefer" or score > top:
                    del taker[mate]
                    taker[node] = (-place, score, "replaced")
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([o for _, o in out], pa.string())], ["node", "outcome"])
            out = []
        out += [(n, o) for n, (_, _, o) in taker.items()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([o for _, o in out], pa.string())], ["node", "outcome"])

    done = rows.mapInArrow(scan, "node long, outcome string")
    return simple.unionByName(say(every.join(done, "node"), F.col("outcome")))


def view_groups(f: DataFrame, threshold: float = 0.1, distance: float = 0.0) -> DataFrame:
    """f with root: connected components of IoU above the threshold or, with a distance, of near centres."""
    s = materialize(_slim(f, []), "view-rows")
    tile, parts = tile_size(s), None
    for _ in range(64):
        # the least neighbour of each row, aggregated as the pairs are found: no pair is written
        here = s if parts is None else s.join(parts, "seq", "left").withColumn("root", F.coalesce("root", "seq"))
        own = "seq" if parts is None else "root"
        apart = F.col(f"a.{own}") > F.col(f"b.{own}") if parts is None else F.col("a.root") != F.col("b.root")
        met = _over(tile_pairs(here, here, tile, None, True, apart), threshold, [F.col(f"a.{own}").alias("a"), F.col(f"b.{own}").alias("b")])
        if distance > 0:
            centre = here.select("seq", *([] if parts is None else ["root"]), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
            two = near_pairs(centre, distance).select(F.col(f"a.{own}").alias("a"), F.col(f"b.{own}").alias("b")).where("a <> b")
            met = met.unionByName(two.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        met = materialize(met.groupBy("a").agg(F.min("b").alias("b")), "view-links")
        if parts is not None and not met.head(1):
            break
        links = components(met)
        if parts is None:
            parts = materialize(links.select(F.col("node").alias("seq"), "root"), "view-parts")
        else:
            up = links.select(F.col("node").alias("root"), F.col("root").alias("to"))
            every = parts.unionByName(links.join(parts.select(F.col("seq").alias("node")), "node", "left_anti").select(F.col("node").alias("seq"), F.col("node").alias("root")))
            parts = materialize(every.join(up, "root", "left").select("seq", F.coalesce("to", "root").alias("root")), "view-parts")
    else:
        raise RuntimeError("view groups did not end")
    return f.join(parts, "seq", "left").withColumn("root", F.coalesce("root", "seq"))


def draw(key: Column, seed: int) -> Column:
    """Seeded pseudorandom order of integer keys, by arithmetic that any engine has (minimal standard generator, two steps)."""
    m = F.lit(2147483647)
    one = F.pmod((key + F.lit(seed)) * F.lit(48271), m)
    return F.pmod(one * F.lit(16807) + F.lit(11), m)


def view_sample(f: DataFrame, k: int = 5, threshold: float = 0.1, distance: float = 0.0, seed: int = 42) -> DataFrame:
    """At most ``k`` rows of each group, drawn by seed."""
    order = W.partitionBy("root").orderBy(draw(F.col("seq"), seed), "seq")
    return view_groups(f, threshold, distance).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k).drop("pick")
