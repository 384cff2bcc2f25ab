"""The operators of this package, each applied to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import avi, lengths, licenses, linededup, mixing, packing, secrets, simhash, toxicity, vptree

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limits(lengths.histogram(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.report(_table(spark, sf_dir, "embeddings"))


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.report(_table(spark, sf_dir, "documents"))


def op7_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_components": op3_simhash_components,
    "op4_packing": op4_packing,
    "op5_vantage_point_search": op5_vantage_point_search,
    "op6_avi_media": op6_avi_media,
    "op7_toxicity_scores": op7_toxicity_scores,
    "op8_license_scan": op8_license_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL = {
    "op1_secret_ownership": secrets.SQL,
    "op5_vantage_point_search": vptree.SQL,
    "op9_source_mixing": mixing.SQL,
    "op10_line_dedup": linededup.SQL,
}
