"""Corpus preparation from the operators of :mod:`mensura.llm`, stage by stage.

Documents that the quality classifier rejects go; of equal texts the row with the largest
id stays, then of near copies (0.8 of five-word shingles) that with the smallest; what is left is packed into
training sequences.  Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from mensura.llm.common import checkpoint_root, read_table
from mensura.llm.exact_dedup import drop_exact_duplicates
from mensura.llm.importance import drop_low_quality
from mensura.llm.packing import pack
from mensura.llm.queries import BYTE_PAIR_RANKS
from mensura.llm.resembling import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample holds; null texts are empty, and without labels all stay."""
    return drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id; null and empty texts are equal."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with the tokens of all documents; a null or empty text is its end mark."""
    return pack(docs, BYTE_PAIR_RANKS)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# A hashed model, components of near copies and best fit are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    folder = f"{checkpoint_root(spark)}/corpus-{uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
