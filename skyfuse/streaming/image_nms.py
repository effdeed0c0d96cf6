"""Per-image suppression of features that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.fusion import suppressed


def suppress_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, threshold: float = 0.2, once: bool = True) -> StreamingQuery:
    """Reads new Parquet files of features (an image's features come in one file), suppresses by image and appends to ``sink``.

    Each batch writes under its number, so a repeated batch replaces its own rows.
    """
    feed = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, no: int) -> None:
        suppressed(rows, threshold, ["src"]).write.mode("overwrite").parquet(f"{sink}/batch={no}")

    out = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
