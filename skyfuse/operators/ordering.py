"""Places in a total order: row numbers over all rows without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize

#: Up to this many rows one window is cheaper than a range shuffle and its prefix sums.
ONE_TASK = 1_000_000


def placed(df: DataFrame, order: list[Column], name: str = "place", rows: int | None = None, cols: list[str] | None = None) -> DataFrame:
    """df (or its ``cols``) with its place (from 1, long) in the order.  Range partitions are numbered each, then moved by the rows before them."""
    cols = cols or df.columns
    n = df.count() if rows is None else rows
    if n <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long")).select(*cols, name)
    # rows are numbered in their sorted range partition as they are written: the id holds the partition above bit 33
    d = df.repartitionByRange(max(2, n // (ONE_TASK // 4)), *order).sortWithinPartitions(*order)
    d = materialize(d.select(*cols, F.monotonically_increasing_id().alias("_id")), "places")
    d = d.withColumn("_p", F.shiftright("_id", 33).cast("int"))
    before, base = 0, []
    for p, k in sorted((r["_p"], r["count"]) for r in d.groupBy("_p").count().collect()):  # one row for each partition
        base.append((p, before - (p << 33) + 1))
        before += k
    base = F.broadcast(df.sparkSession.createDataFrame(base, "_p int, _base long"))
    return d.join(base, "_p").withColumn(name, F.col("_base") + F.col("_id")).drop("_p", "_id", "_base")


def quantiles(df: DataFrame, col: str, shares: tuple[float, ...], rows: int) -> list[float]:
    """Interpolated quantiles of a column without nulls, read off at their places: no task holds all values."""
    at = {s: (rows - 1) * s for s in shares}
    need = sorted({p for v in at.values() for p in (int(v) + 1, min(int(v) + 2, rows))})
    got = placed(df.select(col), [F.asc(col)], "_place", rows).where(F.col("_place").isin(need)).collect()  # two rows a quantile
    value = {r["_place"]: r[col] for r in got}
    low = {s: value[int(v) + 1] for s, v in at.items()}
    return [low[s] + (value[min(int(at[s]) + 2, rows)] - low[s]) * (at[s] - int(at[s])) for s in shares]
