"""Spatial joins of boxes as equi-joins on tiles.

Each box goes to the tiles that it covers; boxes meet in equal tiles, and a pair is kept only in the tile that holds
the lower left corner of the common part, so that it comes once without a distinct.  The overlap test stands in the
join condition.  Tiles bound how many boxes meet; AQE splits tiles that are hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import BOX, overlaps


def tile_size(boxes: DataFrame, share: float = 0.99, least: float = 1e-6) -> float:
    """A side that ``share`` of the boxes' sides don't exceed."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    got = boxes.agg(F.percentile_approx(side, share, 1000)).first()[0]
    return max(float(got or 1.0), least)


def tiled(boxes: DataFrame, tile: float) -> DataFrame:
    """Boxes, once for each covered tile, with columns tx and ty."""
    n = lambda c: F.floor(F.col(c) / F.lit(float(tile)))
    return boxes.withColumn("tx", F.explode(F.sequence(n("x1"), n("x2")))).withColumn("ty", F.explode(F.sequence(n("y1"), n("y2"))))


def spread(left: DataFrame, right: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Both with tiles (tx, ty) in which they meet: a box of ``left`` no larger than a tile goes to one tile only, those of ``right`` to their tiles and the ones before."""
    n = lambda c: F.floor(F.col(c) / F.lit(float(tile)))
    a = left.withColumns({"_tx": n("x1"), "_ty": n("y1")})
    a = a.withColumn("tx", F.explode(F.sequence("_tx", F.greatest(F.col("_tx"), n("x2") - 1)))).withColumn("ty", F.explode(F.sequence("_ty", F.greatest(F.col("_ty"), n("y2") - 1))))
    b = right.withColumns({"_tx": n("x1") - 1, "_ty": n("y1") - 1})
    return a, b.withColumn("tx", F.explode(F.sequence("_tx", n("x2")))).withColumn("ty", F.explode(F.sequence("_ty", n("y2"))))


def few_tile_pairs(left: DataFrame, right: DataFrame, tile: float, keys: list[str] | None = None, closed: bool = True) -> DataFrame:
    """The pairs of ``tile_pairs`` for a ``left`` of many rows, tiled as in ``spread``.

    The sides are shuffled, not broadcast: either may be too large for one machine's memory.
    """
    return meet(*spread(left, right, tile), keys, closed)


def meet(a: DataFrame, b: DataFrame, keys: list[str] | None = None, closed: bool = True) -> DataFrame:
    """The pairs of both sides of ``spread``."""
    on = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    for k in keys or []:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    here = (F.greatest("a._tx", "b._tx") == F.col("a.tx")) & (F.greatest("a._ty", "b._ty") == F.col("a.ty"))
    return a.alias("a").join(b.alias("b").hint("merge"), on & here & overlaps("a", "b", closed))


def tile_pairs(left: DataFrame, right: DataFrame, tile: float, keys: list[str] | None = None, closed: bool = True, also: Column | None = None, kind: str = "inner") -> DataFrame:
    """Overlapping pairs as columns of ``left`` under alias a and of ``right`` under alias b.

    ``keys``: further columns that must be equal; ``also``: further condition on a and b, such as a.seq < b.seq.
    Rows with a null coordinate overlap nothing.
    """
    a, b = tiled(left, tile).alias("a"), tiled(right, tile).alias("b")
    on = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    for k in keys or []:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    t = F.lit(float(tile))
    here = (F.floor(F.greatest(F.col("a.x1"), F.col("b.x1")) / t) == F.col("a.tx")) & (F.floor(F.greatest(F.col("a.y1"), F.col("b.y1")) / t) == F.col("a.ty"))
    on &= here & overlaps("a", "b", closed)
    return a.join(b, on if also is None else on & also, kind)


def near_pairs(points: DataFrame, distance: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs (a, b), a.seq < b.seq, of points (x, y) at most ``distance`` apart: tiles of that side, each point to its 3 x 3 neighbours."""
    d = F.lit(float(max(distance, 1e-9)))
    cell = points.withColumn("tx", F.floor(F.col("x") / d)).withColumn("ty", F.floor(F.col("y") / d))
    step = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    wide = cell.withColumn("ox", F.explode(step)).withColumn("oy", F.explode(step)).withColumn("tx", F.col("tx") + F.col("ox")).withColumn("ty", F.col("ty") + F.col("oy")).drop("ox", "oy")
    on = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")) & (F.col("a.seq") < F.col("b.seq"))
    for k in keys or []:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    # a table that looks small may be large once it is spread: no side is collected for a broadcast
    return wide.alias("a").join(cell.alias("b").hint("merge"), on & (dx * dx + dy * dy <= F.lit(float(distance) * float(distance))))


__all__ = ["BOX", "few_tile_pairs", "meet", "near_pairs", "spread", "tile_pairs", "tile_size", "tiled"]
