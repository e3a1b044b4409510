"""The corpus pipeline: five stages, each one operator of ``sensorloom.llm``.

Every stage works on all that its predecessor kept. The duplicate stage takes shingles of five words at a
similarity of 0.8. The last stage turns the documents into pieces of packed sequences. SQL cannot express
the third, fourth and fifth stage; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import persist
from sensorloom.llm.exact_dedup import exact_dedup
from sensorloom.llm.minhash import near_dedup
from sensorloom.llm.mixing import mixed
from sensorloom.llm.packing import pack
from sensorloom.llm.quality import filtered


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filtered(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("minhash near-dedup", near_duplicates),
    ("mixing", source_weights),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persist(docs, f"stage{i}")
    return docs
