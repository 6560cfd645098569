"""Scaling of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.columns import bounded, ratio
from mensura.functions.lineage import cut
from mensura.operators.quantiles import quantiles
from mensura.operators.running import running_sum


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population deviation of each column."""
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less the fitted mean over the fitted deviation; null and constant columns give zero."""

    def scaled(c: str) -> Column:
        return F.coalesce(ratio(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")), F.lit(0.0))

    joined = df.join(F.broadcast(scaler))  # one row
    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def z_scored(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, columns), columns)


def block_normalised(df: DataFrame, blocks: list[list[str]]) -> DataFrame:
    """Each block of features over the root of its size."""
    return df.withColumns({c: F.col(c) / F.sqrt(F.lit(float(len(block)))) for block in blocks for c in block})


def weighted(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * w for c, w in weights.items()})


def unit_range(df: DataFrame, value: str, out: str) -> DataFrame:
    """Values from the least (0) to the greatest (1); a constant gives zero."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")  # one row


def to_byte(df: DataFrame, value: str, out: str, how: str = "percentile", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values as 0 to 255: over their range, between percentiles, or of their logarithm."""
    source = F.log1p(F.col(value)) if how == "log" else F.col(value)
    ends = quantiles(df, [], source, {"_lo": low, "_hi": high}) if how == "percentile" else df.select(source.alias("_lo"), source.alias("_hi"))
    span = ends.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    scaled = bounded(F.coalesce(ratio(source - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)), 0.0, 1.0) * 255
    return df.join(F.broadcast(span)).withColumn(out, F.floor(scaled).cast("int")).drop("_lo", "_hi")  # one row


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows up to each."""
    counts = cut(df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    whole = counts.agg(F.sum("n").alias("_all"))
    return running_sum(counts, [], "v", "n", "_below").join(F.broadcast(whole)).select("v", (F.col("_below") / F.col("_all")).alias("cdf"))  # one row


def matched_to(df: DataFrame, value: str, reference: DataFrame, reference_value: str, out: str) -> DataFrame:
    """Values moved so that their distribution is the reference's.

    A value of cumulative share q becomes the reference value at q, by linear
    interpolation.  Work grows with distinct values, of which an image has few.
    """
    own, ref = distribution(df, value), distribution(reference, reference_value)
    order = Window.orderBy("cdf")
    steps = ref.select("cdf", "v", F.lag("cdf").over(order).alias("cdf0"), F.lag("v").over(order).alias("v0"))
    # the step of each value: the first reference share that is not smaller
    both = own.select("cdf", F.lit(0).alias("side"), "v", F.lit(None).cast("double").alias("cdf0"), F.lit(None).cast("double").alias("v0"), F.lit(None).cast("double").alias("v1"))
    both = both.unionByName(steps.select("cdf", F.lit(1).alias("side"), F.lit(None).cast("double").alias("v"), "cdf0", "v0", F.col("v").alias("v1")))
    step = F.first(F.when(F.col("side") == 1, F.struct("cdf", "cdf0", "v0", "v1")), ignorenulls=True).over(
        Window.orderBy("cdf", "side").rowsBetween(0, Window.unboundedFollowing)
    )
    found = both.withColumn("s", step).where("side = 0")
    moved = F.when(F.col("s.cdf0").isNull(), F.col("s.v1")).otherwise(
        F.col("s.v0") + (F.col("s.v1") - F.col("s.v0")) * ratio(F.col("cdf") - F.col("s.cdf0"), F.col("s.cdf") - F.col("s.cdf0"))
    )
    lut = found.select(F.col("v").alias("_v"), moved.alias(out))
    return df.join(lut, F.col(value).cast("double") == F.col("_v")).drop("_v")
