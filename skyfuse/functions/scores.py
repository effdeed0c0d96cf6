"""Geometry-prior scores of a detection as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6


@dataclass(frozen=True)
class Prior:
    """Expected object size and how strictly each trait counts."""

    length: float = 2.2
    width: float = 1.1
    area_target: float = 0.0
    ratio_target: float = 0.0
    beta_area: float = 0.8
    sigma_ratio: float = 0.0
    beta_ratio: float = 0.35
    beta_shape: float = 0.2
    w_area: float = 15.0
    w_ratio: float = 10.0
    w_shape: float = 5.0
    w_sem: float = 0.2
    w_pv: float = 0.8
    combine: str = "mean"  # or "product"
    gamma: float = 1.0


def decay(delta: Column, beta) -> Column:
    return F.exp(-F.abs(delta) / F.greatest(F.lit(float(beta)) if not isinstance(beta, Column) else beta, F.lit(FLOOR)))


def bell(delta: Column, sigma: float) -> Column:
    s = max(sigma, FLOOR)
    return F.exp(-(delta * delta) / F.lit(2.0 * s * s))


def trait_scores(area: Column, rect_w: Column, rect_h: Column, rect_area: Column, p: Prior) -> dict[str, Column]:
    """aspect_ratio, area_score, ratio_score, shape_score of a shape and its enclosing rectangle."""
    target = p.area_target if p.area_target > 0 else max(p.length * p.width, FLOOR)
    ratio_target = p.ratio_target if p.ratio_target > 0 else max(p.length / max(p.width, FLOOR), FLOOR)
    ratio = F.when((rect_w > 0) & (rect_h > 0), F.greatest(rect_w / rect_h, rect_h / rect_w)).otherwise(F.lit(0.0))
    shape = F.when(rect_area > 0, decay(area / rect_area - 1, p.beta_shape)).otherwise(F.lit(0.0))
    return {"aspect_ratio": ratio, "area_score": decay(area - target, target * p.beta_area), "ratio_score": bell(ratio - ratio_target, p.sigma_ratio or p.beta_ratio), "shape_score": shape}


def prior_score(t: dict[str, Column], p: Prior) -> Column:
    """con_pv: weighted mean of the traits, or (area x shape) ** gamma."""
    if p.combine == "product":
        return F.pow(t["area_score"] * t["shape_score"] if p.w_shape > 0 else t["area_score"], F.lit(p.gamma))
    total = max(p.w_area + p.w_ratio + p.w_shape, FLOOR)
    return (F.lit(p.w_area) * t["area_score"] + F.lit(p.w_ratio) * t["ratio_score"] + F.lit(p.w_shape) * t["shape_score"]) / F.lit(total)


def fused_weight(sem: Column, pv: Column, p: Prior) -> Column:
    """con_weight: the semantic and the geometric score by their weights."""
    return (F.lit(p.w_sem) * sem + F.lit(p.w_pv) * pv) / F.lit(max(p.w_sem + p.w_pv, FLOOR))
