"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014), all in DataFrames.

Each round is checkpointed in the shared folder.  A star's centre may have many neighbours: its minimum is
pre-aggregated before the shuffle and joined back, so no group is collected.  Up to ``FEW_EDGES`` edges are joined up
in one task instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_root

#: So many edges (16 bytes each) are one task's work.
FEW_EDGES = 100_000


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges, by union-find in one task."""

    def run(batches):
        import pyarrow as pa

        above: dict[int, int] = {}

        def root(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long").checkpoint()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> rows (node, root), root the smallest node that it reaches; nodes without an edge don't come."""
    shared_root(edges.sparkSession)  # sets a checkpoint folder where there is none
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    if e.count() <= FEW_EDGES:
        return _joined(e)
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: every edge points down already, so a node's smaller neighbours meet at the least of them
        small = large.join(low, "a").select(F.col("b").alias("x"), "m", "a")
        e = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first())
        if now == seen and now[0] == now[2]:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
