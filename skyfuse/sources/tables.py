"""Pose tables, prompt boxes, logs and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import name_candidates

BOM = "﻿"


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last in ``order``."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a list, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def resolved(paths: DataFrame, root: str | None) -> DataFrame:
    """Relative paths joined to the root."""
    p = F.col("value")
    return paths.withColumn("value", F.when(F.startswith(p, F.lit("/")) | F.lit(not root), p).otherwise(F.concat_ws("/", F.lit((root or "").rstrip("/")), p)))


def image_list(spark: SparkSession, paths: list[str] | None = None, pattern: str | None = None, lists: str | None = None, root: str | None = None) -> DataFrame:
    """(value, no): images named one by one, by a glob, or by a list file, each once, in order of first mention; an error where there are none.

    The glob is resolved by Spark's own file listing, so any store that Spark reads will do.
    """
    parts = []
    if paths:
        parts.append(resolved(spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "at long, value string"), root).withColumn("src", F.lit(0)))
    if pattern:
        files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("value"))
        parts.append(files.withColumn("at", F.row_number().over(W.orderBy("value")).cast("long")).withColumn("src", F.lit(1)))
    if lists:
        lines = resolved(list_file(spark, lists), root)
        parts.append(lines.withColumn("at", F.monotonically_increasing_id()).withColumn("src", F.lit(2)))
    if not parts:
        raise ValueError("no image source is named")
    every = parts[0].select("src", "at", "value")
    for p in parts[1:]:
        every = every.unionByName(p.select("src", "at", "value"))
    first = every.groupBy("value").agg(F.min(F.struct("src", "at")).alias("k"))
    out = first.withColumn("no", F.row_number().over(W.orderBy("k")) - 1).select("value", "no")  # a list of images, one job's worth
    if not out.head(1):
        raise ValueError("no images found")
    return out


def poses(spark: SparkSession, path: str) -> DataFrame:
    """(name, xs, ys, zs, phi, omega, kappa) of lines with seven fields and more; of a repeated name the last line; text that is no number is null."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())  # one file: order of its lines
    f = F.split("value", ",")
    row = lines.where(F.size(f) >= 7).select("at", F.trim(f[0]).alias("name"), *[F.trim(f[k + 1]).try_cast("double").alias(c) for k, c in enumerate(("xs", "ys", "zs", "phi", "omega", "kappa"))])
    return last_wins(row, ["name"], "at").drop("at")


def keyed_by_name(files: DataFrame, path_col: str, named: DataFrame, name_col: str = "name") -> DataFrame:
    """Left join of paths with named rows by the first of the path's name candidates that exists."""
    tries = files.select(path_col, F.posexplode(name_candidates(F.col(path_col))).alias("_try", "_name"))
    hit = tries.join(named.withColumnRenamed(name_col, "_name"), "_name")
    best = hit.groupBy(path_col).agg(F.min_by(F.struct(*[c for c in named.columns if c != name_col]), "_try").alias("_r"))
    return files.join(best, path_col, "left").select(*files.columns, "_r.*")


def prompt_boxes(spark: SparkSession, path: str, least_area: float = 500.0) -> DataFrame:
    """(src, x1, y1, x2, y2) of text files with four numbers a line; smaller boxes are dropped."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("src"), F.split(F.trim("value"), r"[,\s]+").alias("f"))
    b = lines.where(F.size("f") == 4).select("src", *[F.col("f")[k].try_cast("double").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]).dropna()
    return b.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area)


def write_prompts(boxes: DataFrame, path: str) -> None:
    """One folder of text files for each image; boxes(src, value)."""
    boxes.select("src", "value").repartition("src").write.mode("overwrite").partitionBy("src").text(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as rows; times stay strings, which order as they are."""
    return spark.read.json(path)


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Worker summaries (one JSON file each); files that can't be read give no row."""
    return spark.read.option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def result_rows(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV with a header, with or without a byte order mark; of a repeated (station, iter, variant) the last row."""
    d = spark.read.option("header", True).csv(path)
    d = d.toDF(*[c.replace(BOM, "") for c in d.columns]).withColumn("_at", F.monotonically_increasing_id())
    return last_wins(d, ["station", "iter", "variant"], "_at").drop("_at")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def result_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, iter, variant): predictions by folder: .../iter_N/variant/..., .../variant/iter_N/..., iter_N alone, or variant alone."""
    p = F.col(path_col)
    it = F.regexp_extract(p, r"iter_(\d+)", 1)
    rest = F.regexp_replace(F.regexp_replace(p, r"/?iter_\d+", ""), r"/[^/]*$", "")
    variant = F.regexp_extract(rest, r"([^/]+)$", 1)
    return files.where(~p.contains("/cache/")).select(p.alias("path"), F.coalesce(it.try_cast("int"), F.lit(0)).alias("iter"), variant.alias("variant"))


