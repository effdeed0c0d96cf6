"""Detection inputs derived from the supplied tables, as DataFrames and as the SQL of the same views.

One list of expressions makes both, in SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import ONE_TASK, placed
from ..runtime import importable, materialize


def _gt(px: str, py: str) -> list[str]:
    return ["CAST(p_partkey AS BIGINT) AS gt", f"(p_partkey % 50) * {px} AS x1", f"FLOOR(p_partkey / 50) * {py} AS y1", f"(p_partkey % 50) * {px} + 2.2e0 AS x2", f"FLOOR(p_partkey / 50) * {py} + 1.1e0 AS y2", "1 AS label"]


def _det(px: str, py: str, fx: str, fy: str, s0: str, sd: str) -> list[str]:
    left, low = f"(l_partkey % 50) * {px} + (l_discount - 0.05e0) * {fx}", f"FLOOR(l_partkey / 50) * {py} + (l_tax - 0.04e0) * {fy}"
    size = f"({s0} + l_quantity / {sd})"
    return ["CAST(l_partkey AS BIGINT) AS module", "CAST(l_suppkey AS BIGINT) AS img", "concat('img_', CAST(l_suppkey AS VARCHAR(20)), '.JPG') AS src", "0.45e0 + 0.55e0 * ((CAST(ROUND(l_extendedprice * 100e0) AS BIGINT) % 1000) / 1000e0) AS score", f"{left} AS x1", f"{low} AS y1", f"{left} + 2.2e0 * {size} AS x2", f"{low} + 1.1e0 * {size} AS y2", "1 AS label"]


ALIGNED, DRIFT = ("2.4e0", "1.3e0", "4e0", "2e0", "0.9e0", "250e0"), ("2.25e0", "1.15e0", "6e0", "3e0", "0.75e0", "100e0")
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
USED = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
ORTHO = ["CAST(p_partkey AS BIGINT) AS seq", "(p_partkey % 50) * 2.4e0 + ((p_size % 7) - 3) * 0.05e0 AS x1", "FLOOR(p_partkey / 50) * 1.3e0 AS y1", "(p_partkey % 50) * 2.4e0 + ((p_size % 7) - 3) * 0.05e0 + 2.2e0 AS x2", "FLOOR(p_partkey / 50) * 1.3e0 + 1.1e0 AS y2", "0.9e0 + (p_size % 50) / 500e0 AS score"]
IMAGES = ["CAST(s_suppkey AS BIGINT) AS img", "concat('img_', CAST(s_suppkey AS VARCHAR(20)), '.JPG') AS src", "CAST(s_nationkey % 3 AS INT) AS station", "(s_suppkey % 10) * 12e0 AS xs", "FLOOR(s_suppkey / 10) * 6e0 AS ys", "80e0 + s_nationkey AS zs", "CASE WHEN s_suppkey % 4 = 0 THEN 0e0 ELSE 0.5e0 END AS phi", "0e0 AS omega", "(s_nationkey - 12) * 0.25e0 AS kappa", "CAST(3000 + (s_suppkey % 7) * 517 AS INT) AS width", "CAST(2000 + (s_suppkey % 5) * 333 AS INT) AS height"]
RUNS = ["event_id AS seq", "CAST(user_id % 4 AS INT) AS rank_id", "CAST(FLOOR(event_id / 200) AS BIGINT) AS run_no", "event_type AS stage", "value AS elapsed_ms"]
RESULTS = ["o_custkey % 3 AS station", "o_orderkey % 3 AS iter", "o_orderpriority AS variant"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def truth(spark: SparkSession, sf: str, drift: bool = False) -> DataFrame:
    return _table(spark, sf, "part").selectExpr(*_gt(*(DRIFT if drift else ALIGNED)[:2]))


def detections(spark: SparkSession, sf: str, drift: bool = False, keep: bool = False) -> DataFrame:
    """Each line item is one sighting of its part in its supplier's image; seq is its place in the order of the lines.

    ``keep`` is for plans that read the rows more than once: they are written, unless they were for their places.
    """
    li = _table(spark, sf, "lineitem").select(*ORDER)
    n = li.count()
    li = placed(li, [F.asc(c) for c in ORDER], "seq", n, USED)
    d = li.selectExpr("seq", *_det(*(DRIFT if drift else ALIGNED)))
    return materialize(d, "detections") if keep and n <= ONE_TASK else d


def ortho(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").where("p_partkey % 5 <> 0").selectExpr(*ORTHO)


def images(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "supplier").selectExpr(*IMAGES)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").selectExpr(*RUNS)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy counts by (station, iter, variant): n_pred, tp."""
    r = _table(spark, sf, "orders").selectExpr(*RESULTS, "o_orderstatus")
    return r.groupBy("station", "iter", "variant").agg(F.count("*").alias("n_pred"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("tp"))


def sql(*names: str) -> str:
    """WITH list of the named views (det, drift, gt, gt_drift, ortho, img, runs, results)."""
    def det(p):
        return f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {', '.join(ORDER)}) AS BIGINT) AS seq, {', '.join(_det(*p))} FROM lineitem"

    made = {
        "det": det(ALIGNED),
        "drift": det(DRIFT),
        "gt": f"SELECT {', '.join(_gt(*ALIGNED[:2]))} FROM part",
        "gt_drift": f"SELECT {', '.join(_gt(*DRIFT[:2]))} FROM part",
        "ortho": f"SELECT {', '.join(ORTHO)} FROM part WHERE p_partkey % 5 <> 0",
        "img": f"SELECT {', '.join(IMAGES)} FROM supplier",
        "runs": f"SELECT {', '.join(RUNS)} FROM events",
        "results": f"SELECT {', '.join(RESULTS)}, COUNT(*) AS n_pred, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM orders GROUP BY ALL",
    }
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({made[n]})" for n in names)
