"""Choosing, renaming and aligning columns; dropping empty and constant ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def listed(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the order of the list."""
    return df.select([c for c in names if c in df.columns])


def with_keywords(columns: list[str], keywords: list[str], how: str = "any") -> list[str]:
    """Names that hold any or all of the keywords; case counts."""
    test = {"any": any, "all": all}[how]
    return [c for c in columns if test(k in c for k in keywords)]


def narrowed(df: DataFrame, groups: list[list[str]], key: str) -> DataFrame:
    """The key and the columns that hold a keyword of every group."""
    names = reduce(lambda left, words: with_keywords(left, words), groups, [c for c in df.columns if c != key])
    return df.select(key, *names)


def numeric(df: DataFrame, besides: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in besides]


def renamed(df: DataFrame, words: dict[str, str]) -> DataFrame:
    """Every keyword replaced in every column name, one after the other."""
    return df.toDF(*[reduce(lambda c, kv: c.replace(*kv), words.items(), c) for c in df.columns])


def prefixed(df: DataFrame, prefix: str, keys: tuple[str, ...] = (), suffix: str = "") -> DataFrame:
    return df.toDF(*[c if c in keys else f"{prefix}{c}{suffix}" for c in df.columns])


def compared(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that both have, and that only one has."""
    return {"both": [c for c in a.columns if c in b.columns], "left": [c for c in a.columns if c not in b.columns], "right": [c for c in b.columns if c not in a.columns]}


def without_repeated(df: DataFrame, other: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns that ``other`` has too, but for those to keep."""
    return df.drop(*[c for c in df.columns if c in other.columns and c not in keep])


def aligned(df: DataFrame, like: DataFrame, fill: float = 0.0) -> DataFrame:
    """The columns of both, those of ``like`` first; missing ones hold ``fill``."""
    names = [*like.columns, *[c for c in df.columns if c not in like.columns]]
    return df.select([F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in names])


def by_kind(columns: list[str], kinds: dict[str, str]) -> dict[str, list[str]]:
    """Names grouped by the first kind whose keyword they hold."""
    found: dict[str, list[str]] = {kind: [] for kind in kinds}
    for c in columns:
        kind = next((k for k, word in kinds.items() if word in c), None)
        if kind:
            found[kind].append(c)
    return found


def null_shares(df: DataFrame) -> DataFrame:
    """One row with the share of nulls of every column."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])


def without_empty(df: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, list[str]]:
    """``df`` without columns of more nulls than the threshold, and their names."""
    shares = null_shares(df).first().asDict()
    gone = [c for c in df.columns if (shares[c] or 0) > threshold]
    return df.drop(*gone), gone


def without_constant(df: DataFrame, keys: tuple[str, ...] = (), threshold: float = 0.0) -> tuple[DataFrame, list[str]]:
    """``df`` without numeric columns whose deviation is at most the threshold, and their names."""
    names = numeric(df, keys)
    if not names:
        return df, []
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in names]).first().asDict()
    gone = [c for c in names if spread[c] is None or spread[c] <= threshold]
    return df.drop(*gone), gone


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column, and whether no row shares one; a null row does not count as distinct."""
    rows = [F.struct(F.lit(c).alias("name"), F.count_distinct(c).alias("n"), (F.count_distinct(c) == F.count(F.lit(1))).alias("is_unique")) for c in columns]
    return df.agg(F.array(*rows).alias("u")).select(F.inline("u"))
