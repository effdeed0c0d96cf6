"""Feature tables: defaults at the reader, the 18-column export, Parquet by image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import box_ring
from ..functions.rings import bounds, valid_ring
from ..operators.ordering import placed

#: Columns of the export, in order (fixed values).
EXPORT = ("id", "label", "src", "method", "con", "con_sem", "con_pv", "con_weight", "area", "ratio", "tilt", "azimuth", "z_mean", "z_min", "z_max", "pf_inlier", "pf_rmse", "n_ring")
TEXT_LENGTH = 240


def with_defaults(d: DataFrame) -> DataFrame:
    """Probes columns and fills what is missing: score from con_weight, con, con_sem in turn, else 0; label 0, src ''."""
    have = [F.col(c).cast("double") for c in ("con_weight", "con", "con_sem") if c in d.columns]
    d = d.withColumn("score", F.coalesce(*have, F.lit(0.0)))
    fill = {"con_sem": F.col("score"), "con_pv": F.lit(0.0), "con_weight": F.col("score"), "label": F.lit(0), "src": F.lit("")}
    return d.withColumns({c: F.coalesce(F.col(c), v) if c in d.columns else v for c, v in fill.items()})


def read_features(spark: SparkSession, path: str, score: str | None = None) -> DataFrame:
    """Parquet features with defaults; rows without a ring and without a box are left out; boxes follow the rings."""
    d = with_defaults(spark.read.parquet(path))
    if score:
        d = d.withColumn("score", F.coalesce(F.col(score).cast("double"), "score"))
    if "seg" in d.columns:
        d = d.withColumn("seg", F.filter("seg", lambda r: valid_ring(r)))
        d = d.where((F.size("seg") > 0) | F.col("x1").isNotNull()).withColumn("_b", bounds(F.col("seg")))
        d = d.withColumns({c: F.when(F.size("seg") > 0, F.col(f"_b.{c}")).otherwise(F.col(c)) for c in ("x1", "y1", "x2", "y2")}).drop("_b")
    return d


def exported(f: DataFrame) -> DataFrame:
    """The export columns and the rings: id is the place in seq order, given before rows without geometry are left out; angles in degrees."""
    d = placed(f, [F.asc("seq")], "id")
    rings = F.coalesce(F.when(F.size("seg") > 0, F.col("seg")), F.when(box_ring().isNotNull(), F.array(box_ring()))) if "seg" in f.columns else F.array_compact(F.array(box_ring()))
    d = d.withColumn("rings", rings).where(F.size("rings") > 0)
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, TEXT_LENGTH)
    z = F.flatten("seg_z") if "seg_z" in f.columns else F.lit(None).cast("array<double>")
    has = lambda c, kind="double": F.col(c).cast(kind) if c in f.columns else F.lit(None).cast(kind)
    cols = {"id": F.col("id"), "label": has("label", "int"), "src": cut("src") if "src" in f.columns else F.lit(""), "method": cut("method") if "method" in f.columns else F.lit(""), "con": has("score"), "con_sem": has("con_sem"), "con_pv": has("con_pv"), "con_weight": has("con_weight"), "area": has("area"), "ratio": has("aspect_ratio"), "tilt": F.degrees(has("tilt")), "azimuth": F.degrees(has("azimuth")), "z_mean": F.aggregate(z, F.lit(0.0), lambda a, v: a + v) / F.size(z), "z_min": F.array_min(z), "z_max": F.array_max(z), "pf_inlier": has("pf_inlier", "int"), "pf_rmse": has("pf_rmse"), "n_ring": F.size("rings")}
    return d.select(*[cols[c].alias(c) for c in EXPORT], "rings")


def write_features(f: DataFrame, path: str, by: str = "src") -> None:
    f.write.mode("overwrite").partitionBy(by).parquet(path)
