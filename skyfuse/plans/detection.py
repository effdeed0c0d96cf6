"""The detection pipeline: raw predictions to fused features and the prompts of the next round.

Stages are lazy DataFrames; nothing is ordered by worker, and only selection rounds write what they iterate over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.boxes import box_ring
from ..functions.polygons import shape_columns, smallest_rectangle
from ..functions.rings import affine, bounds
from ..operators import fusion, prompts, terrain
from ..operators import windows as win
from ..operators.reports import converged
from ..runtime import materialize
from .config import Config


@dataclass
class Round:
    features: DataFrame
    fused: DataFrame
    prompts: dict[str, DataFrame]
    counts: list[tuple[str, int, int]]


def located(raw: DataFrame, images: DataFrame, ground: terrain.Terrain | None, cfg: Config) -> DataFrame:
    """Raw pixel features (seq, src, seg, score) on the map.

    Images with a geotransform go through it, others from their pose over the terrain; failed ones are named *_failed
    and dropped here.
    """
    i = images.select("src", "geotransform", *[F.col(c) for c in ("xs", "ys", "zs", "phi", "omega", "kappa")])
    d = raw.withColumn("_b", bounds(F.col("seg"))).select("*", *[F.col(f"_b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).drop("_b").join(i, "src")
    flat = d.where("geotransform is not null").withColumn("seg", affine(F.col("seg"), [F.col("geotransform")[k] for k in range(6)])).withColumn("method", F.lit("geotransform"))
    out = flat
    if ground is not None:
        tall = terrain.projected(d.where("geotransform is null"), ground, cfg.camera, cfg.rays, cfg.projection)
        out = flat.unionByName(tall, allowMissingColumns=True)
    out = out.where(~F.endswith("method", F.lit("_failed"))).drop("x1", "y1", "x2", "y2")
    return out.withColumn("_b", bounds(F.col("seg"))).select("*", *[F.col(f"_b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).drop("_b")


def weighed(f: DataFrame, cfg: Config) -> DataFrame:
    """Adds area, trait scores, con_sem, con_pv, con_weight and score; drops scores under the threshold if there is one."""
    d = f.withColumn("con_sem", F.col("score")).withColumn("_s", shape_columns(F.col("seg"))).withColumn("area", F.col("_s.area"))
    t = scores.trait_scores(F.col("area"), F.col("_s.rect_w"), F.col("_s.rect_h"), F.col("_s.rect_area"), cfg.prior)
    d = d.withColumns(t).drop("_s")
    d = d.withColumn("con_pv", scores.prior_score({k: F.col(k) for k in t}, cfg.prior))
    d = d.withColumn("con_weight", F.when(F.col("area") > 0, scores.fused_weight(F.col("con_sem"), F.col("con_pv"), cfg.prior)).otherwise(0.0))
    d = d.withColumn("score", F.col("con_weight"))
    return d.where(F.col("score") >= cfg.score_threshold) if cfg.score_threshold > 0 else d


def run_round(raw: DataFrame, images: DataFrame, ground: terrain.Terrain | None, cfg: Config = Config(), ortho: DataFrame | None = None) -> Round:
    """One round over all images: early filter, location, scores, suppression by image, view sampling, fusion, merge, prompts."""
    counts: list[tuple[str, int, int]] = []

    def step(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
        after = materialize(after, name)
        counts.append((name, before.count(), after.count()))
        return after

    kept = win.early_filter(raw, cfg.windows.min_score, cfg.windows.min_area_px)
    lost = kept.join(images.select("src"), "src", "left_anti").count()
    if lost:  # features of images that aren't listed have nowhere to go
        counts.append(("image-not-listed", lost, 0))
    f = step("features", raw, weighed(located(kept, images, ground, cfg), cfg))
    u = cfg.fusion
    d = step("image-nms", f, fusion.suppressed(f, u.image_iou, ["src"])) if u.image_nms else f
    if u.views:
        d = step("views", d, fusion.view_sample(d, u.views_k, u.views_iou, u.views_distance, u.seed).drop("root"))
    voted = u.method == "pixel_vote"  # then a second source votes too, and isn't merged
    second = ortho if u.merge else None
    out = step("fusion", d, fusion.fused(d, u.method, u.iou, second if voted else None))
    if second is not None and not voted:
        out = step("merge", out, fusion.merge_sources(out, second, u.strategy, u.merge_iou))
    return Round(f, out, made_prompts(out, images, cfg, ground=ground), counts)


def prompt_corners(f: DataFrame, height: float, ground: terrain.Terrain | None = None) -> DataFrame:
    """f(seq, x1..y2 [, seg]) -> (seq, gx0..gz3): the corners of the smallest rectangle around the ring (the box without one), at the terrain's height under each, or ``height``."""
    names = [f"g{a}{k}" for k in range(4) for a in "xyz"]
    ring = F.coalesce(F.element_at("seg", 1), box_ring()) if "seg" in f.columns else box_ring()
    if ground is not None and ground.heights is not None and ground.heights.nbytes > terrain.BROADCAST:
        ground = ground.stored(f.sparkSession)
    sent = f.sparkSession.sparkContext.broadcast(ground)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ground = sent.value
        for b in batches:
            rings = [np.asarray(r, float).reshape(-1, 2) for r in b.column(1).to_pylist()]
            c = np.array([smallest_rectangle(r.ravel())[3] if len(r) > 2 and smallest_rectangle(r.ravel())[2] > 0 else r[[0, 1, 2, 3]] for r in rings]).reshape(-1, 4, 2)
            z = np.full(c.shape[:2], float(height))
            if ground is not None and len(c):
                under = ground.under(c[:, :, 0].ravel(), c[:, :, 1].ravel()).reshape(z.shape)
                z = np.where(np.isfinite(under), under, z)
            every = np.concatenate([c, z[:, :, None]], axis=2).reshape(-1, 12)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(every[:, k]) for k in range(12)]], ["seq", *names])

    return f.select("seq", ring.alias("ring")).where("ring is not null").mapInArrow(run, "seq long, " + ", ".join(f"{n} double" for n in names))


def made_prompts(f: DataFrame, images: DataFrame, cfg: Config, ground_height: float | None = None, ground: terrain.Terrain | None = None) -> dict[str, DataFrame]:
    """Prompt boxes of the next round by kind: in georeferenced images, and in a feature's own photos and those whose footprint it meets."""
    p, out = cfg.prompts, {}
    if p.mode not in ("oblique", "ortho", "both"):
        raise ValueError(f"unknown prompt mode {p.mode!r}")
    if p.mode in ("ortho", "both"):
        flat = images.where("geotransform is not null").select("src", "geotransform", "width", "height").limit(1).collect()  # the one orthophoto
        for r in flat:
            out["ortho"] = prompts.box_lines(prompts.ortho_boxes(f.select("seq", "x1", "y1", "x2", "y2"), list(r.geotransform), r.width, r.height, least=p.min_size_ortho), 6)
    if p.mode in ("oblique", "both"):
        from ..operators.tile_join import tile_pairs

        photos = images.where("geotransform is null").withColumn("img", F.col("src"))
        foot = prompts.footprints(photos, cfg.camera)
        good = f.where(F.col("score") >= p.min_confidence)
        met = tile_pairs(good.select("seq", "x1", "y1", "x2", "y2"), foot, 20.0).select("a.seq", F.col("b.img").alias("src"))
        if "src" in f.columns:  # its own photos too, wherever their footprints lie
            met = met.unionByName(good.select("seq", F.explode(F.split("src", ";")).alias("src")))
        corners = prompt_corners(good, cfg.camera.mean_height if ground_height is None else ground_height, ground)
        c = met.distinct().join(corners, "seq").join(photos.drop("img"), "src")
        out["oblique"] = prompts.box_lines(prompts.photo_boxes(c, cfg.camera, p.min_size))
    return out


def iterate(first: Round, again, evaluate, most: int = 3) -> list[Round]:
    """Rounds until F1 and the number of predictions settle: ``again(prompts)`` gives the next round, ``evaluate(fused)`` a row with f1 and n_pred."""
    rounds, last = [first], evaluate(first.fused)
    for _ in range(most - 1):
        rounds.append(again(rounds[-1].prompts))
        now = evaluate(rounds[-1].fused)
        if converged(last, now).first()[0]:
            break
        last = now
    return rounds


def view_counts(text: str) -> list[int | None]:
    """'1-3,20,all' -> [1, 2, 3, 20, None]; None: no sampling."""
    out: list[int | None] = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        if part == "all":
            out.append(None)
        elif "-" in part:
            a, b = map(int, part.split("-"))
            if a < 1 or b < a:
                raise ValueError(f"bad range {part!r}")
            out += range(a, b + 1)
        else:
            out.append(int(part))
    return out


def preflight(images: DataFrame, poses: DataFrame) -> DataFrame:
    """(level, what, n): images without a pose, poses without an image, repeated names."""
    miss = images.join(poses, "src", "left_anti").agg(F.lit("fail").alias("level"), F.lit("image without pose").alias("what"), F.count("*").alias("n"))
    idle = poses.join(images, "src", "left_anti").agg(F.lit("warn").alias("level"), F.lit("pose without image").alias("what"), F.count("*").alias("n"))
    twice = images.groupBy("src").count().where("count > 1").agg(F.lit("fail").alias("level"), F.lit("repeated image").alias("what"), F.count("*").alias("n"))
    return miss.unionByName(idle).unionByName(twice)
