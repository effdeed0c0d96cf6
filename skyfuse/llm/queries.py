"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, mixing, neighbours, packing, quality, secret_scan, simhash, substring, text_search, token_files
from .common import documents, importable


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), eos=1, length=2048)


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.search(documents(spark, sf_dir), every=100, k=10)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(documents(spark, sf_dir))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), eos=2))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated_spans(documents(spark, sf_dir), span=50).drop("spans")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_search, op4_mixing, op5_substring, op6_secrets, op7_licenses, op8_neighbours, op9_token_files, op10_simhash)}
ORACLES: dict[str, str] = {"op3_search": text_search.oracle(), "op7_licenses": license_scan.oracle()}
