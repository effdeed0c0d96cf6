"""Covered area of whole scenes, tile by tile: features are clipped to tiles, and tiles add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import covered_areas, indicator_edges
from .tile_join import tiled


def scene_areas(pred: DataFrame, gt: DataFrame, tile: float) -> DataFrame:
    """One row: pred, gt and common covered area, and their iou, dice, precision and recall.

    Equal clipped boxes of a tile fold into one before they meet, so a tile holds its distinct boxes only.  With a
    segmentation in ``seg`` on both sides the polygons count; those that aren't valid cover nothing.
    """
    t = F.lit(float(tile))
    if "seg" in pred.columns and "seg" in gt.columns:
        return _shares(_polygon_cover(pred, gt, tile))

    def clipped(f: DataFrame, side: int) -> DataFrame:
        d = tiled(f.select("x1", "y1", "x2", "y2"), tile)
        lo = lambda c, n: F.greatest(F.col(c), F.col(n) * t).alias(c)
        hi = lambda c, n: F.least(F.col(c), (F.col(n) + 1) * t).alias(c)
        return d.select("tx", "ty", lo("x1", "tx"), lo("y1", "ty"), hi("x2", "tx"), hi("y2", "ty")).distinct().withColumn("side", F.lit(side))

    def cover(pdf):
        import numpy as np
        import pandas as pd

        x, y = np.unique(pdf[["x1", "x2"]].to_numpy()), np.unique(pdf[["y1", "y2"]].to_numpy())
        seen = np.zeros((2, len(x), len(y)), np.int64)  # corners of boxes, then prefix sums: how many cover a cell
        for s, x1, y1, x2, y2 in pdf[["side", "x1", "y1", "x2", "y2"]].itertuples(index=False):
            a, b, c, d = np.searchsorted(x, x1), np.searchsorted(x, x2), np.searchsorted(y, y1), np.searchsorted(y, y2)
            seen[int(s), a, c] += 1
            seen[int(s), b, c] -= 1
            seen[int(s), a, d] -= 1
            seen[int(s), b, d] += 1
        on = seen.cumsum(axis=1).cumsum(axis=2)[:, :-1, :-1] > 0
        cell = np.outer(np.diff(x), np.diff(y))
        return pd.DataFrame([(float(cell[on[0]].sum()), float(cell[on[1]].sum()), float(cell[on[0] & on[1]].sum()))], columns=["p", "g", "both"])

    parts = clipped(pred, 0).unionByName(clipped(gt, 1)).groupBy("tx", "ty").applyInPandas(cover, "p double, g double, both double")
    return _shares(parts)


def _shares(parts: DataFrame) -> DataFrame:
    """parts(p, g, both) of the tiles -> the row of the whole."""
    s = parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("p", "g", "both")])
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both, p, g = F.col("both"), F.col("p"), F.col("g")
    return s.select(p.alias("pred_area"), g.alias("gt_area"), both.alias("common"), part(both, p + g - both).alias("iou"), part(2 * both, p + g).alias("dice"), part(both, p).alias("precision"), part(both, g).alias("recall"))


def _polygon_cover(pred: DataFrame, gt: DataFrame, tile: float) -> DataFrame:
    """(p, g, both) for each tile, by slabs over the edges that reach it."""
    rows = pred.select("x1", "y1", "x2", "y2", "seg").withColumn("side", F.lit(0)).unionByName(gt.select("x1", "y1", "x2", "y2", "seg").withColumn("side", F.lit(1)))
    met = tiled(rows, tile).select("tx", "ty", "side", "seg").distinct()

    def cover(pdf):
        import pandas as pd

        x, y = float(pdf["tx"].iloc[0]) * tile, float(pdf["ty"].iloc[0]) * tile
        rings = lambda v: None if v is None else [None if r is None else list(r) for r in v]
        shape = [indicator_edges([rings(v) for v in pdf.loc[pdf["side"] == k, "seg"]]) for k in (0, 1)]
        out = covered_areas(shape[0], shape[1], (x, y, x + tile, y + tile))
        return pd.DataFrame([out], columns=["p", "g", "both"])

    return met.groupBy("tx", "ty").applyInPandas(cover, "p double, g double, both double")
