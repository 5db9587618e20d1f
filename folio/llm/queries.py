"""Queries of this subpackage for the registry: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, filter_audit, licenses, packing, quality, sharding, simhash, suffix_tree, telephony, token_files, toxicity, url_filter
from .common import documents
from .tokens import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    words = "word_bpe_49k.json"
    return {
        "op1_sharding": lambda spark, sf_dir: sharding.shard(documents(spark, sf_dir)),
        "op2_quality_rules": lambda spark, sf_dir: quality.op2(documents(spark, sf_dir)),
        "op3_license_scans": lambda spark, sf_dir: licenses.op3(documents(spark, sf_dir)),
        "op4_simhash_near_dedup": lambda spark, sf_dir: simhash.op4(documents(spark, sf_dir)),
        "op5_token_files": lambda spark, sf_dir: token_files.op5(documents(spark, sf_dir), vocabulary(words)),
        "op6_byte_bpe": op6,
        "op7_toxicity": lambda spark, sf_dir: toxicity.op7(documents(spark, sf_dir), _labels(spark, sf_dir)),
        "op8_media_columns": lambda spark, sf_dir: telephony.op8(documents(spark, sf_dir)),
        "op9_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir), vocabulary(words)),
        "op10_url_filters": lambda spark, sf_dir: url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op11_centroid_clustering": lambda spark, sf_dir: centroids.op11(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op12_filter_interaction_audit": lambda spark, sf_dir: filter_audit.audit(documents(spark, sf_dir), _labels(spark, sf_dir)),
        "op13_lm_scoring": lambda spark, sf_dir: suffix_tree.scores(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.ORACLE, "op3_license_scans": licenses.ORACLE, "op10_url_filters": url_filter.ORACLE, "op11_centroid_clustering": centroids.ORACLE, "op12_filter_interaction_audit": filter_audit.ORACLE}
