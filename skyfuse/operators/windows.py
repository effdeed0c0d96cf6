"""Sliding windows over images, and prompt boxes in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fusion import draw


def starts(length: Column, size: int, overlap: float) -> tuple[Column, Column]:
    """(array of window starts along one side, window length): stride by the overlap, the last window aligned with the edge."""
    s = F.greatest(F.lit(1), F.least(F.lit(size), length))
    stride = F.greatest(F.lit(1), F.floor(s * F.lit(1.0 - overlap)).cast("int"))
    last = F.greatest(F.lit(0), length - s)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, stride), F.array(last))), s


def windows(images: DataFrame, size: int = 1024, overlap: float = 0.5) -> DataFrame:
    """images(img, width, height) -> (img, no, x, y, w, h), row by row from 0."""
    xs, w = starts(F.col("width"), size, overlap)
    ys, h = starts(F.col("height"), size, overlap)
    d = images.select("img", "width", "height", w.alias("w"), h.alias("h"), xs.alias("xs"), ys.alias("ys"))
    d = d.select("*", F.posexplode("ys").alias("iy", "y")).select("*", F.posexplode("xs").alias("ix", "x"))
    no = (F.col("iy") * F.size("xs") + F.col("ix")).cast("long")
    return d.select("img", no.alias("no"), "x", "y", F.least(F.col("w"), F.col("width") - F.col("x")).alias("w"), F.least(F.col("h"), F.col("height") - F.col("y")).alias("h"))


def window_prompts(wins: DataFrame, boxes: DataFrame, most: int = 3, seed: int = 42) -> DataFrame:
    """Boxes (img, box, x1..y2) that touch a window, moved to it and clipped; at most ``most`` a window by a seeded draw (0: all)."""
    b, w = boxes.alias("b"), wins.alias("w")
    meets = (F.col("b.x2") >= F.col("w.x")) & (F.col("b.x1") <= F.col("w.x") + F.col("w.w")) & (F.col("b.y2") >= F.col("w.y")) & (F.col("b.y1") <= F.col("w.y") + F.col("w.h"))
    j = w.join(b, (F.col("w.img") == F.col("b.img")) & meets)
    zero, x, y = F.lit(0.0), F.col("w.x"), F.col("w.y")
    local = [F.greatest(F.col("b.x1") - x, zero).alias("x1"), F.greatest(F.col("b.y1") - y, zero).alias("y1"), F.least(F.col("b.x2") - x, F.col("w.w").cast("double")).alias("x2"), F.least(F.col("b.y2") - y, F.col("w.h").cast("double")).alias("y2")]
    out = j.select("w.img", "w.no", "b.box", *local)
    if most > 0:
        order = W.partitionBy("img", "no").orderBy(draw(F.col("box"), seed), "box")
        out = out.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")
    return out


def windows_with_prompts(wins: DataFrame, prompts: DataFrame) -> DataFrame:
    return wins.join(prompts.select("img", "no").distinct(), ["img", "no"], "left_semi")


def early_filter(raw: DataFrame, min_score: float = 0.45, min_area: float = 500.0) -> DataFrame:
    """Drops predictions under the score, or under the pixel area."""
    return raw.where((F.col("score") >= min_score) & (F.col("pixel_area") >= min_area))
