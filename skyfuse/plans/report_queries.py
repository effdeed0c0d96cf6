"""Queries over run logs and result rows: costs, macro averages, iteration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from . import views
from .registry import query


@query(views.sql("runs") + " SELECT stage, count(*) AS n, round(sum(elapsed_ms), 4) AS total_ms, round(sum(elapsed_ms) / greatest(count(*), 1), 6) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms FROM runs GROUP BY stage")
def a14_stage_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = reports.stage_stats(views.run_log(spark, sf))
    return s.select("stage", "n", F.round("total_ms", 4).alias("total_ms"), F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms")


SUMMARIES = ", s AS (SELECT run_no % 5 AS job, seq AS finished, rank_id AS worker, 4 AS world, elapsed_ms AS minutes, 1 AS calls FROM runs)"


@query(views.sql("runs") + SUMMARIES + ", c AS (SELECT job, floor((row_number() OVER (PARTITION BY job ORDER BY finished, worker) - 1) / 4) AS chunk, minutes, calls FROM s), m AS (SELECT job, chunk, max(minutes) AS minutes, sum(calls) AS calls FROM c GROUP BY job, chunk) SELECT job, CAST(sum(calls) AS BIGINT) AS calls, round(sum(minutes), 4) AS wall_minutes, count(*) AS invocations FROM m GROUP BY job")
def a15_wall(spark: SparkSession, sf: str) -> DataFrame:
    r = views.run_log(spark, sf).select((F.col("run_no") % 5).alias("job"), F.col("seq").alias("finished"), F.col("rank_id").alias("worker"), F.lit(4).alias("world"), F.col("elapsed_ms").alias("minutes"), F.lit(1).alias("calls"))
    c = reports.run_costs(r, ["job"])
    return c.select("job", "calls", F.round("wall_minutes", 4).alias("wall_minutes"), "invocations")


@query("SELECT event_type AS stage, min(count_in) AS least, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT event_type, user_id, count(*) AS count_in, count(*) FILTER (WHERE value > 50) - count(*) AS d FROM events GROUP BY ALL) GROUP BY event_type")
def a1_count_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    c = e.groupBy("event_type", "user_id").agg(F.count("*").alias("count_in"), (F.count_if(F.col("value") > 50) - F.count("*")).alias("d"))
    return c.groupBy(F.col("event_type").alias("stage")).agg(F.min("count_in").alias("least"), F.sum("d").alias("delta"))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return views.results(spark, sf).withColumn("f1", F.col("tp") / F.col("n_pred"))


RATES = ", a AS (SELECT *, tp / n_pred AS f1 FROM results)"


@query(views.sql("results") + RATES + " SELECT iter, variant, round(avg(f1), 9) AS f1, round(avg(n_pred), 6) AS n_pred FROM a GROUP BY iter, variant")
def a17_macro(spark: SparkSession, sf: str) -> DataFrame:
    m = reports.macro(_rates(spark, sf), ["iter", "variant"], ["f1", "n_pred"])
    return m.select("iter", "variant", F.round("f1", 9).alias("f1"), F.round("n_pred", 6).alias("n_pred"))


@query(views.sql("results") + RATES + " SELECT iter, variant, round(avg(f1), 9) AS macro, min(f1) AS worst, round(CASE WHEN count(f1) > 1 THEN stddev_pop(f1) END, 9) AS std FROM a GROUP BY iter, variant")
def a18_worst_std(spark: SparkSession, sf: str) -> DataFrame:
    s = reports.spread(_rates(spark, sf), ["iter", "variant"], "f1")
    return s.select("iter", "variant", F.round("macro", 9).alias("macro"), "worst", F.round("std", 9).alias("std"))


COST = ", c AS (SELECT station, iter, CASE WHEN variant = '5-LOW' THEN 'shared' ELSE variant END AS variant, n_pred * 1e0 AS calls FROM results)"


def _cost(spark: SparkSession, sf: str) -> DataFrame:
    return views.results(spark, sf).select("station", "iter", F.when(F.col("variant") == "5-LOW", "shared").otherwise(F.col("variant")).alias("variant"), F.col("n_pred").cast("double").alias("calls"))


@query(views.sql("results") + COST + ", r AS (SELECT station, variant, iter, sum(calls) OVER (PARTITION BY station, variant ORDER BY iter) AS v FROM c WHERE variant <> 'shared'), s AS (SELECT station, sum(calls) AS s FROM c WHERE variant = 'shared' GROUP BY station) SELECT variant, iter, round(avg(v + coalesce(s, 0)), 6) AS calls FROM r LEFT JOIN s USING (station) GROUP BY variant, iter")
def a19_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    c = reports.cumulative_cost(_cost(spark, sf), "calls")
    return c.select("variant", "iter", F.round("calls", 6).alias("calls"))


@query(views.sql("results") + ", c AS (SELECT station, iter, variant, CASE WHEN n_pred % 3 = 0 THEN 0 ELSE n_pred END AS calls FROM results WHERE iter < 2), f AS (SELECT station, iter, variant, tp AS calls FROM results WHERE station > 0) SELECT r.station, r.iter, r.variant, coalesce(nullif(c.calls, 0), nullif(f.calls, 0), c.calls) AS calls FROM results r LEFT JOIN c USING (station, iter, variant) LEFT JOIN f USING (station, iter, variant)")
def j10_cost_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    r, k = views.results(spark, sf), ["station", "iter", "variant"]
    c = r.where("iter < 2").select(*k, F.when(F.col("n_pred") % 3 == 0, F.lit(0)).otherwise(F.col("n_pred")).alias("calls"))
    return reports.with_costs(r.select(*k), c, r.where("station > 0").select(*k, F.col("tp").alias("calls")), k, "calls")


@query("SELECT CAST(c AS DOUBLE) AS cell, v AS min_votes, CAST(a AS DOUBLE) AS min_area FROM (VALUES (0.1), (0.2), (0.4)) t(c), (VALUES (2), (5), (10), (20)) u(v), (VALUES (0.0), (0.5)) w(a)")
def j14_grid(spark: SparkSession, sf: str) -> DataFrame:
    from .sweep import grid

    return grid(spark, (0.1, 0.2, 0.4), (2, 5, 10, 20), (0.0, 0.5))


def table(no: int, configs: list[tuple[str, str, int]]) -> None:
    """Registers a report table: rows of (label, variant, iteration) with macro F1 and counts, and the cumulative cost."""
    values = ", ".join(f"({k}, '{label}', '{v}', {t})" for k, (label, v, t) in enumerate(configs))
    cost = ", k AS (SELECT station, variant, iter, sum(n_pred) OVER (PARTITION BY station, variant ORDER BY iter) AS v FROM results), m AS (SELECT variant, iter, avg(v) AS calls FROM k GROUP BY ALL)"
    sql = views.sql("results") + RATES + cost + f", q(no, label, variant, iter) AS (VALUES {values}) SELECT CAST(q.no AS INT) AS no, label, round(avg(a.f1), 4) AS f1, round(min(a.f1), 4) AS worst, round(any_value(m.calls), 1) AS calls FROM q LEFT JOIN a USING (variant, iter) LEFT JOIN m USING (variant, iter) GROUP BY q.no, label"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        a = _rates(spark, sf)
        q = spark.createDataFrame([(k, *c) for k, c in enumerate(configs)], "no int, label string, variant string, iter long")
        s = reports.spread(a, ["variant", "iter"], "f1")
        c = reports.cumulative_cost(a.withColumn("calls", F.col("n_pred").cast("double")), "calls", "none")
        out = q.join(F.broadcast(s), ["variant", "iter"], "left").join(F.broadcast(c), ["variant", "iter"], "left")  # a few report rows
        return out.select("no", "label", F.round("macro", 4).alias("f1"), F.round("worst", 4).alias("worst"), F.round("calls", 1).alias("calls"))

    run.__name__ = f"table{no}"
    query(sql)(run)


U, H, M, N, L = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"
table(1, [("method a", U, 2), ("method b", H, 2), ("method c", M, 2), ("fused", N, 2)])
table(2, [("method a", U, 2), ("method b", H, 2), ("fused", N, 2), ("absent", "none", 2)])
table(3, [("no feedback", N, 0), ("one source", U, 1), ("other source", H, 1), ("both", N, 1)])
table(4, [("no prior", U, 1), ("area", H, 1), ("shape", M, 1), ("full", N, 1)])
table(5, [("without views", U, 1), ("without ortho", H, 1), ("both", N, 1)])
table(6, [("pixels", M, 2), ("instances", N, 2)])
table(7, [("set 0", U, 1), ("set 1", H, 1), ("set 2", M, 1), ("set 3", N, 1), ("set 4", L, 1)])
table(8, [("t = 0", N, 0), ("t = 1", N, 1), ("t = 2", N, 2)])
