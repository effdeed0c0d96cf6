"""The training-data pipeline: quality, near duplicates, secrets, mix, packing; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyfuse.llm import mixing, packing, quality, secret_scan, simhash
from skyfuse.llm.common import documents, importable, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal classifier rejects (low quality or toxic); it is fitted on labelled rows of this input.

    Null, empty and white texts are dropped; repeated rows go or stay alike; an empty table stays empty.  All columns stay.
    """
    importable(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_documents(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) stays, the one with the smallest doc_id.

    Null and empty texts are one group; rows with a null id stay only where their group has no other; of rows alike in
    id and text one stays, whatever their other columns hold.
    """
    importable(spark)
    return simhash.similar_deduplicated(docs, words=5, least=(4, 5))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones too; secrets in them become [SECRET].  Null and empty texts stay as they are."""
    importable(spark)
    return secret_scan.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: once for each pass, cut to the words taken.

    Documents without words don't come; a null source is a source of its own; repeated rows are taken each by itself.
    """
    importable(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; a null or empty text is its end id alone, an empty table gives no pieces."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), eos=1, length=2048)


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier, the similarity groups and the draws aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
