"""Exact quantiles of groups of any size."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mensura.functions.lineage import cut
from mensura.operators.joins import joined_unskewed
from mensura.operators.running import part_of

PARTS = 64


@F.pandas_udf(DoubleType())
def _between(low: pd.Series, high: pd.Series, share: pd.Series) -> pd.Series:
    """The value at a share of the way between finite neighbours, rounded as the SQL engine rounds it; a row for each group."""
    known = [math.isfinite(a) and math.isfinite(b) for a, b in zip(low, high)]
    return pd.Series([math.fma(1.0 - d, a, d * b) if k else None for a, b, d, k in zip(low, high, share, known)], dtype="float64")


def quantiles(df: DataFrame, by: list[str], value: str | Column, shares: dict[str, float], parts: int = PARTS, times: str | None = None) -> DataFrame:
    """A column for each name of ``shares`` with that quantile of the group's values, interpolated between neighbours.

    A row counts once, or as often as the column ``times`` says.  Equal values are counted first.  A group's distinct values are cut at approximate
    quantiles, the parts are counted, and only those parts that hold a wanted rank are
    ordered: a task has a share of 1 / ``parts`` of a group's distinct values to sort, which
    spills, and never a group.  Null values don't count and a group without others has no
    row; null keys make a group; NaN is the greatest value.  Cuts differ with the order in
    which parts of the input arrive, so they are worked out once and kept.
    """
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))  # null fields of structs are equal
    often = (F.col(times) if times else F.lit(1)).cast("long")
    counts = cut(df.select(key.alias("_k"), number.alias("_v"), often.alias("_n")).where("_v is not null").groupBy("_k", "_v").agg(F.sum("_n").alias("_n")))
    cuts = cut(counts.groupBy("_k").agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)]).alias("_cuts"), F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("n")))
    placed = joined_unskewed(counts, cuts, ["_k"]).withColumn("_part", part_of("_cuts", "_v", parts)).drop("_cuts", "n")

    place = {name: F.lit(float(share)) * (F.col("_size") - 1) for name, share in shares.items()}
    ranks = {name: (F.floor(p), F.ceil(p)) for name, p in place.items()}
    totals = placed.groupBy("_k", "_size", "_part").agg(F.sum("_n").alias("_t"))
    ends = totals.withColumn("_end", F.sum("_t").over(Window.partitionBy("_k").orderBy("_part")))  # at most ``parts`` rows a group
    held = reduce(Column.__or__, [(F.col("_end") - F.col("_t") <= r) & (r < F.col("_end")) for pair in ranks.values() for r in pair])
    asked = ends.where(held).select("_k", "_part", (F.col("_end") - F.col("_t")).alias("_start"))

    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy("_k", "_part").orderBy("_v"))
    ordered = placed.join(asked, ["_k", "_part"]).withColumn("_upto", upto)
    found = []
    for name, (lower, upper) in ranks.items():
        found += [F.min(F.when(F.col("_upto") > r, F.col("_v"))).alias(f"{name}_{end}") for end, r in (("l", lower), ("u", upper))]
    neighbours = ordered.groupBy("_k", "_size").agg(*found)

    def between(name: str) -> Column:
        low, high = F.col(f"{name}_l"), F.col(f"{name}_u")
        lower, upper = ranks[name]
        share = place[name] - lower
        plain = (upper - place[name]) * low + share * high  # with infinities and NaN
        return F.when(low == high, low).otherwise(F.coalesce(_between(low, high, share), plain)).alias(name)

    return neighbours.select(*[F.col("_k")[c].alias(c) for c in by], *[between(name) for name in shares])


def with_quantiles(grouped: DataFrame, df: DataFrame, by: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """``grouped``, a row for each group of ``df``, with the quantiles of the groups; null where a group has no value."""
    found = quantiles(df, by, value, shares).withColumnsRenamed({c: f"_{c}_" for c in by})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by])
    return grouped.join(found, same, "left").drop(*[f"_{c}_" for c in by])
