"""Word rules and inputs of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable, materialize, new_folder  # noqa: F401

#: One word of the contracts: a run of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text) -> F.Column:
    """Number of contract words of a text column, JVM-side; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_words(data: bytes, chunk: int = 1 << 20):
    """Lists of the words of UTF-8 ``data``, about ``chunk`` bytes of text at a time, so that long texts stay bounded."""
    if len(data) <= chunk:
        yield data.split()
        return
    at = 0
    while at < len(data):
        to = min(at + chunk, len(data))
        while to < len(data) and data[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield data[at:to].split()
        at = to
