"""Run costs, view sets and result tables: joins and aggregates over logs and accuracy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """log(stage, elapsed_ms) -> count, total, avg, min and max by stage."""
    v = F.col("elapsed_ms")
    return log.groupBy(*(by or []), "stage").agg(F.count("*").alias("n"), F.sum(v).alias("total_ms"), (F.sum(v) / F.greatest(F.count("*"), F.lit(1))).alias("avg_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))


def run_costs(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Worker summaries (keys, finished, world, minutes, calls) -> calls, wall minutes, invocations and world by key.

    By finish order, each ``world`` summaries are one invocation, as long as its slowest worker; invocations add up.
    """
    order = W.partitionBy(*keys).orderBy("finished", "worker")
    s = summaries.withColumn("world", F.max(F.greatest("world", F.lit(1))).over(W.partitionBy(*keys)))
    s = s.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / F.col("world")))
    c = s.groupBy(*keys, "chunk").agg(F.max("minutes").alias("minutes"), F.sum("calls").alias("calls"), F.max("world").alias("world"))
    return c.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("minutes").alias("wall_minutes"), F.count("*").alias("invocations"), F.max("world").alias("world"))


def with_costs(accuracy: DataFrame, cost: DataFrame, fallback: DataFrame, keys: list[str], field: str) -> DataFrame:
    """accuracy with the field of ``cost``, or of ``fallback`` where that is absent or zero."""
    c, f = (x.select(*keys, F.col(field).alias(n)) for x, n in ((cost, "_c"), (fallback, "_f")))
    v = F.coalesce(F.nullif(F.col("_c"), F.lit(0)), F.nullif(F.col("_f"), F.lit(0)), F.col("_c"))
    return accuracy.join(c, keys, "left").join(f, keys, "left").withColumn(field, v).drop("_c", "_f")


def macro(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Mean over stations of each field, missing values ignored."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in fields])


def spread(rows: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Mean, worst and population deviation (from two stations on) over stations."""
    v = F.col(field)
    return rows.groupBy(*keys).agg(F.avg(v).alias("macro"), F.min(v).alias("worst"), F.when(F.count(v) > 1, F.stddev_pop(v)).alias("std"))


def cumulative_cost(cost: DataFrame, field: str, shared: str = "shared") -> DataFrame:
    """cost(station, iter, variant, field) -> (variant, iter, field): running sum over iterations, the shared pass added once, mean over stations."""
    run = W.partitionBy("station", "variant").orderBy("iter")
    once = cost.where(F.col("variant") == shared).groupBy("station").agg(F.sum(field).alias("_s"))
    c = cost.where(F.col("variant") != shared).withColumn("_v", F.sum(field).over(run)).join(once, "station", "left")
    return c.groupBy("variant", "iter").agg(F.avg(F.col("_v") + F.coalesce("_s", F.lit(0.0))).alias(field))


#: Path of a folder of logs under its station -> (iteration, variant): iter_<t>/full, iter_<t>/shared, iter_<t>/dirs/<name>, <name>/iter_<t>, <name>/iter_<t>/dom (fixed formats).
LOG_PATHS = ((r"^iter_(\d+)/(full|shared)/logs$", 1, 2), (r"^iter_(\d+)/dirs/([^/]+)/logs$", 1, 2), (r"^(?!iter_\d+/)([^/]+)/iter_(\d+)(/dom)?/logs$", 2, 1))


def log_key(path: Column) -> Column:
    """Struct (iter, variant) of a log folder's path under its station; null for folders that no result is told of."""
    at = lambda pattern, k: F.regexp_extract(path, pattern, k)
    found = [F.when(F.regexp_like(path, F.lit(p)), F.struct(at(p, i).cast("int").alias("iter"), at(p, v).alias("variant"))) for p, i, v in LOG_PATHS]
    return F.coalesce(*found)


def folded_logs(costs: DataFrame, sums: list[str], most: list[str], path: str = "path", station: str = "station") -> DataFrame:
    """costs(station, path, ...) by log folder -> by (station, iter, variant): ``sums`` add up, of ``most`` the largest stays, folders are listed."""
    d = costs.withColumn("key", log_key(F.col(path))).where("key is not null")
    folders = F.array_join(F.array_sort(F.collect_set(path)), ";").alias("logs_dir")
    return d.groupBy(station, F.col("key.iter").alias("iter"), F.col("key.variant").alias("variant")).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most], folders)


def with_quality(rows: DataFrame) -> DataFrame:
    """rows with sq, rq and pq where they are missing or zero: mean IoU of the matches, F1, and their product to six decimals."""
    kept = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), other) if c in rows.columns else other
    d = rows.withColumns({"sq": kept("sq", F.col("obj_miou")), "rq": kept("rq", F.col("obj_f1"))})
    return d.withColumn("pq", F.coalesce(F.nullif(F.col("pq"), F.lit(0.0)), F.round(F.col("sq") * F.col("rq"), 6)) if "pq" in rows.columns else F.round(F.col("sq") * F.col("rq"), 6))


def shuffled(keys: list, seed: int = 42) -> list:
    """The few distinct keys in the order that a seeded Fisher-Yates shuffle gives to their sorted list."""
    import random

    out = sorted(keys)
    random.Random(seed).shuffle(out)
    return out


def seeded_view_sets(images: DataFrame, tilt: str = "tilt", azimuth: str = "azimuth", nadir_deg: float = 10.0, seed: int = 42) -> DataFrame:
    """images(img, tilt, azimuth in degrees) -> (set, img): set 0 holds nothing, 1 the images within ``nadir_deg`` of straight down, each further set one azimuth octant more, in seeded order."""
    d = images.select("img", (F.floor(F.col(azimuth) / 45) * 45).cast("int").alias("octant"), (F.col(tilt) < nadir_deg).alias("down"))
    order = shuffled([r.octant for r in d.where(~F.col("down")).select("octant").distinct().collect()], seed)  # nine octants at most
    place = F.coalesce(*[F.when(F.col("octant") == o, F.lit(k + 2)) for k, o in enumerate(order)], F.lit(1))
    d = d.withColumn("no", F.when(F.col("down"), 1).otherwise(place))
    return d.select(F.explode(F.sequence("no", F.lit(len(order) + 1))).alias("set"), "img")


def view_sets(images: DataFrame, direction: str = "direction", first: str = "nadir") -> DataFrame:
    """images(img, direction) -> (set, img): set 0 holds nothing, 1 the nadir images, and each further set one more direction."""
    groups = images.select(direction).distinct().withColumn("no", F.row_number().over(W.orderBy((F.col(direction) != first).cast("int"), direction)))  # at most nine directions
    n = groups.agg(F.max("no").alias("n"))
    d = images.join(groups, direction).join(n)
    return d.select(F.explode(F.sequence("no", "n")).alias("set"), "img")


def converged(prev: DataFrame, now: DataFrame, f1: float = 0.005, share: float = 0.01) -> Column | DataFrame:
    """One row: whether a round changed F1 by less than ``f1`` and the number of predictions by less than ``share``."""
    a, b = prev.select(F.col("f1").alias("f0"), F.col("n_pred").alias("n0")), now.select("f1", "n_pred")
    return a.join(b).select(((F.abs(F.col("f1") - F.col("f0")) < f1) & (F.abs(F.col("n_pred") - F.col("n0")) < share * F.greatest(F.col("n0"), F.lit(1)))).alias("converged"))


def text_table(rows: DataFrame, missing: str = "--") -> str:
    """A small report frame as a Markdown table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(missing if v is None else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join(lines)
