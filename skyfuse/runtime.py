"""Shared folder, written tables and worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when it ends; folder of the tables under the shared root.
CLEANUP, ROOT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "skyfuse"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (clusters: the same path, or --py-files)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; local sessions without one (tests) get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root:
        return root.rstrip("/")
    jdir = sc._jsc.sc().getCheckpointDir()
    if not jdir.isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyfuse-"))
        jdir = sc._jsc.sc().getCheckpointDir()
    return str(jdir.get()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{ROOT}/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write are no longer needed once it is done, and go with it.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/rows"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, when nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/rows/", 1)[0] for f in t.inputFiles() if f"{ROOT}/" in f}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def cheap(df: DataFrame) -> bool:
    """Whether reading ``df`` again costs no more than reading written tables: files, columns, filters and joins with broadcast tables."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "Join" and "broadcast" not in node.toString().split("\n", 1)[0]:
            return False
        if name not in ("Project", "Filter", "Join", "LogicalRDD", "LocalRelation") and not name.startswith("Relation") and name != "LogicalRelation" or not node.deterministic():
            return False
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return True
