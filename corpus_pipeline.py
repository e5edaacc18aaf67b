"""A corpus from raw documents to packed sequences, in five stages.

Every stage gets all that the one before it kept, as a table read back from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import language_id, mixing, packing, quality_rules, simhash
from stemma.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's thresholds keep."""
    return quality_rules.apply(docs).where("__qr_kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, by a model learnt from these documents."""
    return language_id.apply(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 1024 tokens."""
    return packing.apply(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: XXH64 and byte-pair encoding can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
