"""The corpus pipeline: documents in, packed sequences out.

``STAGES`` names the steps in order.  Each takes ``(spark, docs, sf_dir)`` and returns what it keeps of
``docs`` with all of its columns; the last returns the packed pieces.  Every stage takes nulls in any
column, empty and very long texts, repeated rows, empty tables and extra columns as the operator that it
calls documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import decontaminate as benchmark
from caseloom.llm import language_id as language
from caseloom.llm.common import keep, read_table, ship_code
from caseloom.llm.exact_dedup import drop_exact_duplicates
from caseloom.llm.pack import pack as packed
from caseloom.llm.simhash_dedup import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised: no letters, or rejected by the calibrated model."""
    ship_code(spark)
    return language.drop_rejected(docs, language.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop all but one of the documents whose texts are equal apart from ASCII case."""
    ship_code(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: fingerprints of four-word shingles that agree
    in at least 60 of 64 bits, linked through others or directly."""
    ship_code(spark)
    return drop_near_duplicates(docs, words=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more repeats windows of ``benchmark`` items."""
    ship_code(spark)
    return benchmark.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    ship_code(spark)
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# Language model, tokens and linear program are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next stage."""
    ship_code(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
