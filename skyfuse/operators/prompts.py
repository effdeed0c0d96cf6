"""Boxes that prompt the next round: image footprints on the ground, map boxes in the orthophoto, map boxes in photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import Camera, map_to_pixel, rotation, to_ground, to_photo

FAR = 1e11


def _pose() -> tuple[list[Column], list[Column]]:
    num = lambda c: F.col(c).try_cast("double")
    return [num(c) for c in ("xs", "ys", "zs")], rotation(num("phi"), num("omega"), num("kappa"))


def footprints(images: DataFrame, cam: Camera = Camera()) -> DataFrame:
    """images with poses -> (img, x1, y1, x2, y2): ground bounds of the photo at the mean height; bad poses and far corners are dropped."""
    place, rot = _pose()
    corners = [to_ground([F.lit(x - cam.cx), F.lit(cam.cy - y)], F.lit(cam.mean_height), place, rot, cam.focal) for x, y in ((0.0, 0.0), (float(cam.width), 0.0), (float(cam.width), float(cam.height)), (0.0, float(cam.height)))]
    d = images.withColumns({f"_{a}{k}": c[i] for k, c in enumerate(corners) for i, a in enumerate("xy")})
    bound = lambda f, a: f(*[F.col(f"_{a}{k}") for k in range(4)])
    near = F.lit(True)
    for k in range(4):
        near &= (F.abs(F.col(f"_x{k}")) <= FAR) & (F.abs(F.col(f"_y{k}")) <= FAR)
    return d.where(near).select("img", bound(F.least, "x").alias("x1"), bound(F.least, "y").alias("y1"), bound(F.greatest, "x").alias("x2"), bound(F.greatest, "y").alias("y2"))


def ortho_boxes(f: DataFrame, gt: list[float], width: int, height: int, clip: bool = True, normalized: bool = False, least: float = 0.0) -> DataFrame:
    """Map boxes as pixel boxes of a georeferenced image; clipped to it, or left out where they miss it; empty ones never come."""
    g = [F.lit(float(v)) for v in gt]
    p = [map_to_pixel(g, F.col(x), F.col(y)) for x in ("x1", "x2") for y in ("y1", "y2")]
    d = f.withColumns({f"_{n}": fn(*[q[k] for q in p]) for k, a in enumerate("xy") for n, fn in ((f"{a}1", F.least), (f"{a}2", F.greatest))})
    size = {"x": F.lit(float(width)), "y": F.lit(float(height))}
    if clip:
        d = d.withColumns({f"_{a}{k}": F.greatest(F.lit(0.0), F.least(F.col(f"_{a}{k}"), size[a])) for a in "xy" for k in (1, 2)})
    else:
        d = d.where((F.col("_x2") >= 0) & (F.col("_y2") >= 0) & (F.col("_x1") <= size["x"]) & (F.col("_y1") <= size["y"]))
    d = d.where((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")) & (F.col("_x2") - F.col("_x1") >= least) & (F.col("_y2") - F.col("_y1") >= least))
    scale = lambda a: size[a] if normalized else F.lit(1.0)
    return d.select(*[c for c in f.columns if c not in ("x1", "y1", "x2", "y2")], *[(F.col(f"_{a}{k}") / scale(a)).alias(f"{a}{k}") for k in (1, 2) for a in "xy"])


def photo_boxes(corners: DataFrame, cam: Camera = Camera(), least: float = 50.0) -> DataFrame:
    """Rows with a pose and four ground corners gx0..gz3 -> pixel boxes that are large enough and inside the photo."""
    place, rot = _pose()
    p = [to_photo([F.col(f"gx{k}"), F.col(f"gy{k}"), F.col(f"gz{k}")], place, rot, cam.focal) for k in range(4)]
    u, v = [q[0] + cam.cx for q in p], [F.lit(cam.cy) - q[1] for q in p]
    d = corners.withColumns({"x1": F.least(*u), "y1": F.least(*v), "x2": F.greatest(*u), "y2": F.greatest(*v)})
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= cam.width) & (F.col("y2") <= cam.height)
    return d.where(inside & (F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def box_lines(boxes: DataFrame, decimals: int | None = None) -> DataFrame:
    """x1,y1,x2,y2 as one text column, as prompt files hold it."""
    if decimals is None:
        return boxes.withColumn("value", F.concat_ws(",", "x1", "y1", "x2", "y2"))
    form = ",".join([f"%.{decimals}f"] * 4)
    return boxes.withColumn("value", F.format_string(form, "x1", "y1", "x2", "y2"))
