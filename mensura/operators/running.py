"""Running sums that no single task holds whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.lineage import cut
from mensura.operators.joins import joined_unskewed

PARTS = 64


def part_of(cuts: str, value: str, parts: int) -> Column:
    """How many of the ``parts - 1`` rising cuts lie below the value, by halving."""
    at = F.lit(0)
    for step in (1 << k for k in reversed(range((parts - 1).bit_length()))):
        at = at + F.when(F.get(cuts, at + (step - 1)) < F.col(value), step).otherwise(0)
    return at


def running_sum(df: DataFrame, by: list[str], order: str, value: str, out: str, parts: int = PARTS) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to each row, in ``order``.

    A group is cut at approximate quantiles of the order column; sums run within the cuts,
    and each cut starts from the total of those before it, of which a group has at most
    ``parts``.  So a group may hold any share of all rows.  The order column is numeric and
    has no value twice within a group; rows with null keys fall out.  Cuts differ with the
    order in which parts of the input arrive, so they are worked out once and kept.
    """
    shares = [k / parts for k in range(1, parts)]
    df = cut(df)
    held = F.count(F.lit(1)).alias("_held")
    cuts = cut(df.groupBy(*by).agg(F.percentile_approx(order, shares).alias("_cuts"), *[held] * bool(by)))
    # a group may be any share of the rows, so they are not dealt by it
    marked = joined_unskewed(df, cuts, by, number="_held").drop("_held") if by else df.join(F.broadcast(cuts))  # one row
    marked = marked.withColumn("_part", part_of("_cuts", order, parts)).drop("_cuts")
    totals = marked.groupBy(*by, "_part").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inner = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(order))
    return marked.join(starts, [*by, "_part"]).withColumn(out, F.col("_start") + inner).drop("_part", "_start")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add the number of each row, from zero, in the order of columns that together are unique.

    Rows are dealt to ranges of the order and numbered there; ranges start from the counts
    of those before.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)  # the number of the partition, above that of the row in it
    counts = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _s long"))
    return dealt.withColumn("_p", part).join(table, "_p").withColumn(out, F.col("_s") + F.col("_m") - F.shiftleft("_p", 33)).drop("_m", "_p", "_s")
