"""Corpus pipeline over ``documents``: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept: the first four the columns of
``documents`` (rejected, duplicate and leaking documents are gone, personal data is masked in the text),
the last the placement of every token piece. ``run`` writes each stage's result as Parquet to the
shared checkpoint folder and reads it again, so a lost executor never costs more than a stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, small_batches, table
from tidemark.llm.decontamination import clean
from tidemark.llm.language_id import fit_profiles, keep_known
from tidemark.llm.ngram_join import keep_one
from tidemark.llm.packing import packing_digest
from tidemark.llm.pii import find, redact

#: Near duplicates: words per shingle, and the similarity in per cent.
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    return keep_known(docs, fit_profiles(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return keep_one(docs, WORDS, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    small_batches(spark)
    return redact(docs, find(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and offset."""
    small_batches(spark)
    return packing_digest(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
