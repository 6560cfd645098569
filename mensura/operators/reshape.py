"""Long and wide forms, tagged unions and pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each id and column; values become doubles."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)


def wide_form(df: DataFrame, ids: list[str], name: str, values: list[str], value: str) -> DataFrame:
    """A column for each listed value of ``name`` with its mean."""
    return df.groupBy(*ids).agg(*[F.avg(F.when(F.col(name) == v, F.col(value))).alias(str(v)) for v in values])


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows with the name of their part; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def group_pairs(df: DataFrame, group: str) -> DataFrame:
    """All pairs of distinct groups, the smaller first."""
    names = df.select(group).distinct()
    return names.withColumnRenamed(group, "group1").join(names.withColumnRenamed(group, "group2"), F.col("group1") < F.col("group2"))


def exploded(df: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """A row for each element of an array; an empty one gives a null row."""
    return df.select(*keys, F.explode_outer(values).alias("value"))


def exploded_map(df: DataFrame, keys: list[str], entries: Column) -> DataFrame:
    """A row for each entry of a map."""
    return df.select(*keys, F.explode(entries).alias("key", "value"))


def top_of_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", number).where(F.col("rank") <= k)


def natural_key(text: Column) -> Column:
    """The first run of digits in a text, as a number, for sorting."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("long")


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by the place of a value in a list; others last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def transposed(df: DataFrame, key: str, names: list[str], out: str) -> DataFrame:
    """A small table turned about: a row for each other column, named ``out``, a column for each of the key's ``names``."""
    long = long_form(df, [key], [c for c in df.columns if c != key], out)
    return wide_form(long, [out], key, names, "value")
