"""Summaries by group, compositions, lifetimes and changes over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.columns import adjusted_skewness, ratio, standard_error
from mensura.operators.quantiles import quantiles, with_quantiles
from mensura.operators.schema import numeric


def varying(df: DataFrame, group: str, columns: list[str]) -> list[str]:
    """Columns with more than one value, null counting as one, in at least one group."""
    kinds = df.groupBy(group).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    most = kinds.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if (most[c] or 0) > 1]


def summarised(df: DataFrame, group: str, columns: list[str] | None = None, only_varying: bool = True, least_deviation: float | None = None) -> DataFrame:
    """Mean of every numeric column by group, and median, deviation and skewness.

    With ``only_varying`` the last three are for columns that vary within a group; with
    ``least_deviation`` the skewness is zero where the deviation is smaller or unknown.
    """
    columns = columns or numeric(df, (group,))
    more = varying(df, group, columns) if only_varying else columns
    df = df.where(F.col(group).isNotNull())
    out: list[Column] = [F.avg(c).alias(f"{c}_mean") for c in columns]
    for c in more:
        skew = adjusted_skewness(c)
        if least_deviation is not None:
            skew = F.when(F.stddev_samp(c) >= least_deviation, skew).otherwise(0.0)
        out += [F.stddev_samp(c).alias(f"{c}_std"), skew.alias(f"{c}_skew")]
    grouped = df.groupBy(group).agg(*out)
    if not more:
        return grouped
    pairs = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(more)]
    medians = quantiles(df.select(F.col(group).alias("_group"), F.inline(F.array(*pairs))), ["_group", "_c"], "_x", {"_m": 0.5})
    wide = medians.groupBy("_group").agg(*[F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(f"{c}_median") for i, c in enumerate(more)])
    order = [f"{c}_mean" for c in columns] + [f"{c}_{kind}" for c in more for kind in ("median", "std", "skew")]
    return grouped.join(wide, F.col(group) == F.col("_group"), "left").select(group, *order)


def described(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Number, mean, standard error, deviation and range by group."""
    return df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), standard_error(value).alias("sem"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def population_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column, a row for each."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns]
    return df.agg(F.array(*pairs).alias("m")).select(F.inline("m"))


def variance_change(df: DataFrame, side: str, control: str, treated: str, columns: list[str]) -> DataFrame:
    """Variance of each column on two sides, the change and its direction."""

    def var(c: str, which: str) -> Column:
        return F.var_samp(F.when(F.col(side) == which, F.col(c)))

    pairs = [F.struct(F.lit(c).alias("feature"), var(c, control).alias("control"), var(c, treated).alias("treated")) for c in columns]
    change = F.col("treated") - F.col("control")
    direction = F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("same")
    return df.agg(F.array(*pairs).alias("m")).select(F.inline("m")).withColumns({"change": change, "direction": direction})


def composition(df: DataFrame, keys: list[str], category: str, values: list[str], share: bool = True) -> DataFrame:
    """Number or share of each category by key, one column for each listed value, zero where none."""
    counts = [F.count(F.when(F.col(category) == v, 1)).alias(v) for v in values]
    wide = df.groupBy(*keys).agg(*counts)
    if not share:
        return wide
    whole = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(*keys, *[ratio(F.col(v), whole).alias(v) for v in values])


def shares(df: DataFrame, category: str) -> DataFrame:
    """Number and share of rows of each category."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(whole)).select(category, "n", ratio(F.col("n"), F.col("_all")).alias("share"))  # one row


def list_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upper quartile, mean, population deviation and number of a list's values; zero for an empty list."""
    zero = F.lit(0.0)
    grouped = df.groupBy(*keys).agg(F.coalesce(F.avg(value), zero).alias("mean"), F.coalesce(F.stddev_pop(value), zero).alias("std"), F.count(value).alias("n"))
    return with_quantiles(grouped, df, keys, value, {"q75": 0.75}).select(*keys, F.coalesce("q75", zero).alias("q75"), "mean", "std", "n")


def lifetimes(df: DataFrame, keys: list[str], frame: str, minutes: int = 10) -> DataFrame:
    """First, last and number of frames of each label, and how long it is present."""
    return df.groupBy(*keys).agg(
        F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count_distinct(frame).alias("frames_present"), (F.count_distinct(frame) * minutes).alias("duration")
    )


def new_by_frame(lives: DataFrame, cell: str, frames: DataFrame, frame: str, minutes: int = 10) -> DataFrame:
    """Labels that first appear in each frame of each cell, and their rate; zero where none."""
    seen = lives.groupBy(cell, F.col("first_frame").alias(frame)).agg(F.count(F.lit(1)).alias("new"))
    every = lives.select(cell).distinct().crossJoin(F.broadcast(frames.select(frame).distinct()))  # the frames of a series
    counted = every.join(seen, [cell, frame], "left").select(cell, frame, F.coalesce("new", F.lit(0)).alias("new"))
    return counted.withColumn("rate", F.col("new") / minutes)


def change_from_baseline(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Mean, range and error over keys of the percent change from each key's baseline, by time.

    The baseline is the mean at time zero, or else the earliest value; a zero baseline
    gives no change.
    """
    base = df.groupBy(key).agg(F.avg(F.when(F.col(time) == 0, F.col(value))).alias("_zero"), F.min_by(value, F.struct(time, value)).alias("_first"))
    start = F.nullif(F.coalesce("_zero", "_first"), F.lit(0.0))
    changed = df.join(base, key).withColumn("change", (F.col(value) - start) / start * 100)
    return described(changed, [time], "change")


def normalised_to_start(df: DataFrame, time: str, value: str) -> DataFrame:
    """Mean by time over the mean at time zero."""
    means = df.groupBy(time).agg(F.avg(value).alias("mean"))
    start = means.agg(F.max(F.when(F.col(time) == 0, F.col("mean"))).alias("_start"))
    return means.join(F.broadcast(start)).select(time, "mean", ratio(F.col("mean"), F.col("_start")).alias("relative"))  # one row


def complete_tracks(df: DataFrame, key: str, time: str) -> DataFrame:
    """Rows of the keys that are there at every time that any key has."""
    whole = df.agg(F.count_distinct(time).alias("_all"))
    full = df.groupBy(key).agg(F.count_distinct(time).alias("_n")).join(F.broadcast(whole)).where("_n = _all").select(key)  # one row
    return df.join(full, key, "left_semi")


def difference_between(df: DataFrame, key: str, time: str, value: str, start: int, stop: int) -> DataFrame:
    """Mean at two times, their difference, in percent and by unit of time."""

    def at(t: int) -> Column:
        return F.avg(F.when(F.col(time) == t, F.col(value)))

    wide = df.groupBy(key).agg(at(start).alias("start"), at(stop).alias("stop"))
    gain = F.col("stop") - F.col("start")
    return wide.withColumns({"change": gain, "percent": ratio(gain * 100, F.col("start")), "rate": gain / (stop - start)})


def positives(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows, rows that are positive, and their share."""
    wide = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(flag, 1)).alias("positive"))
    return wide.withColumn("share", ratio(F.col("positive"), F.col("n")))


def ranked_ids(df: DataFrame, group: str, key: str, score: str, k: int) -> DataFrame:
    """Keys of the k largest scores of each group, in order; equal scores go by key."""
    number = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key)))
    top = df.withColumn("_n", number).where(F.col("_n") <= k)
    return top.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(key).alias("id")))), lambda s: s["id"]).alias("ids"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts, density and cumulative share in bins of equal width; the last takes the upper bound."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bin")  # a row for each bin
    return counts.select(
        "bin", "n", (F.col("n") / F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / width).alias("density"),
        (F.sum("n").over(order) / F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("cdf"),
    )
