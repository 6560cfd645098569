"""Outliers, duplicates and mixed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.columns import number_or_null
from mensura.operators.quantiles import quantiles
from mensura.operators.schema import numeric, with_keywords, without_empty


def within_wide_bounds(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95, factor: float = 1.5) -> tuple[DataFrame, list[str]]:
    """Rows inside the quantile bounds of every column, taken one after the other.

    The bounds of a column come from the rows that earlier columns left; nulls fall out.
    Also returns the columns that dropped rows.  A column costs its quantiles and a count.
    """
    culprits, before = [], df.count()
    for c in columns:
        ends = quantiles(df, [], c, {"lo": low, "hi": high}).first()
        if ends is None:
            return df.limit(0), [*culprits, c]
        reach = factor * (ends["hi"] - ends["lo"])
        df = df.where(F.col(c).between(ends["lo"] - reach, ends["hi"] + reach))
        if (after := df.count()) < before:
            culprits.append(c)
        before = after
    return df, culprits


def within_group_quartiles(df: DataFrame, group: str, value: str, factor: float = 1.5) -> DataFrame:
    """Rows whose value is within the group's quartiles, widened by the factor."""
    bounds = quantiles(df, [group], value, {"_q1": 0.25, "_q3": 0.75})
    reach = (F.col("_q3") - F.col("_q1")) * factor
    return df.join(bounds, group).where(F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_q1", "_q3")


def under_percentile_cut(df: DataFrame, group: str, value: str, q: float = 0.9, factor: float = 1.5) -> DataFrame:
    """Rows whose value is at most a multiple of the group's percentile."""
    cuts = quantiles(df, [group], value, {"_cut": q})
    return df.join(cuts, group).where(F.col(value) <= F.col("_cut") * factor).drop("_cut")


def at_time(column: str, value: float) -> Column:
    """Whether a label of mixed spelling ("0", "0.0") names this time."""
    return number_or_null(column) == value


def removed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows that are no longer there."""
    return before.join(after, keys, "left_anti").select(*keys)


def first_of_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in a stated order."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", number).where("_n = 1").drop("_n")


def split_by_confidence(df: DataFrame, confidence: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows over the threshold, and the others, nulls among them."""
    sure = F.coalesce(F.col(confidence) > threshold, F.lit(False))
    return df.where(sure), df.where(~sure)


def clear_of_border(pixels: DataFrame, key: list[str], width: int, height: int) -> DataFrame:
    """Pixels of objects that don't touch the image's edge."""
    edge = pixels.groupBy(*key).agg(F.min("x").alias("_l"), F.max("x").alias("_r"), F.min("y").alias("_t"), F.max("y").alias("_b"))
    touching = edge.where(f"_l = 0 or _t = 0 or _r = {width - 1} or _b = {height - 1}").select(*key)
    return pixels.join(touching, key, "left_anti")


def prepared(df: DataFrame, key: str, features: list[str] = [], empty: float = 0.5, outliers: bool = False) -> DataFrame:  # noqa: B006
    """A sheet of measurements ready for analysis: the key and the features that hold any of the keywords (none: all).

    Columns with more than the share ``empty`` of nulls go; with ``outliers``, rows
    outside the wide bounds of any numeric feature too.
    """
    kept = [c for c in df.columns if c == key or not features or c in with_keywords(df.columns, features)]
    filled, _ = without_empty(df.select(*kept), empty)
    return within_wide_bounds(filled, numeric(filled, (key,)))[0] if outliers else filled
