"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.lineage import checkpoint_root, cut

__all__ = ["body", "checkpoint_root", "cut", "read_table", "shuffle_width"]


def body(column: str | Column) -> Column:
    """Text of a column, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions that the session uses for a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
