"""Registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.session import scratch_path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import extendible_shards
    return extendible_shards(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import packing_digest
    return packing_digest(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import pii_digest
    return pii_digest(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import read_token_files, token_digest, write_token_files
    path = scratch_path(spark, f"llm-token-files-{uuid.uuid4().hex}")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_digest(read_token_files(spark, path))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import jaccard_digest
    return jaccard_digest(table(spark, sf_dir, "documents"))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.extraction import extraction_digest
    return extraction_digest(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import leaks_digest
    return leaks_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprint_digest
    return fingerprint_digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import language_digest
    return language_digest(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import derivatives_digest
    return derivatives_digest(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import divergence
    return divergence(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepieces import pieces_digest
    return pieces_digest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.va_clustering import clusters_digest
    return clusters_digest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_packing, op3_pii, op4_token_files, op5_ngram_join, op6_extraction, op7_decontamination,
                                   op8_fingerprints, op9_language_id, op10_warc, op11_source_divergence, op12_sentencepiece,
                                   op13_centroid_clustering)}


def oracles() -> dict[str, str]:
    from tidemark.llm import divergence, sharding, va_clustering
    return {"op1_sharding": sharding.SQL, "op11_source_divergence": divergence.SQL,
            "op13_centroid_clustering": va_clustering.sql()}
