"""The queries ``opN_<name>``: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import licenses, packing, phrases, quality, sampling, sharding, simhash, substrings, token_output, topk
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-output")
    token_output.write_token_table(_table(spark, sf_dir, "documents"), scratch.path("tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_output.token_digest(spark, scratch.path("tokens"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k_inner(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"), length=200)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_license_scan_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), wrapped=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(_table(spark, sf_dir, "documents"), distance=2)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup_passages(_table(spark, sf_dir, "documents"), width=13)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, limit=2048)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_segmentations(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, alpha=1.0, seed=0)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_quality_rules, op3_top_k, op4_suffix_array_dedup, op5_license_scan, op5_license_scan_wrapped, op6_simhash, op7_substring_dedup, op8_best_fit_packing, op9_sharding, op10_sentencepiece_sampling)}

#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {"op2_quality_rules": quality.ORACLE, "op3_top_k": topk.ORACLE, "op5_license_scan": licenses.ORACLE}
