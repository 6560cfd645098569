"""Tests between groups, effect sizes and correlations, for many features at once.

Tables are long: feature, group, value.  A test is one or two shuffles for all features;
tail probabilities are worked out on the result rows only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mensura.functions import special
from mensura.functions.columns import ratio
from mensura.functions.lineage import cut
from mensura.operators.joins import joined_unskewed
from mensura.operators.quantiles import quantiles
from mensura.operators.reshape import long_form
from mensura.operators.running import running_sum


def value_ranks(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Average rank and number of each distinct value within ``by``.

    Values are counted before they are ordered, so that an order is over distinct values.
    """
    return _ranked(long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties")), by, value)


def _ranked(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    return running_sum(cut(counts), by, value, "ties", "_below").withColumn("rank", F.col("_below") - (F.col("ties") - 1) / 2).drop("_below")


def rank_sums(long: DataFrame, by: list[str], group: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """By group: number and sum of ranks; and overall: number and tie term."""
    # the input is read once: ties, ranks and sums come from the counts
    counts = cut(long.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("n")))
    ranks = cut(_ranked(counts.groupBy(*by, value).agg(F.sum("n").alias("ties")), by, value))
    sums = counts.join(ranks, [*by, value]).groupBy(*by, group).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n")).alias("rank_sum"))
    ties = F.col("ties").cast("double")
    whole = ranks.groupBy(*by).agg(F.sum("ties").alias("total"), F.sum(ties * ties * ties - ties).alias("tie_term"))
    return sums, whole


def kruskal(long: DataFrame, group: str, feature: str = "feature") -> DataFrame:
    """Kruskal-Wallis H with tie correction, degrees of freedom and probability, by feature."""
    sums, whole = rank_sums(long, [feature], group)
    n = F.col("total").cast("double")
    parts = sums.groupBy(feature).agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("groups"), F.min("n").alias("smallest"))
    h = ratio(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("tie_term") / (n * n * n - n))
    out = parts.join(whole, feature).select(feature, "groups", "smallest", h.alias("h"))
    return out.withColumn("p", special.chi2_p("h", F.col("groups") - 1))


def dunn(long: DataFrame, group: str, feature: str = "feature", how: str = "fdr_bh") -> DataFrame:
    """Dunn's z of every pair of groups, the smaller first, by feature, and its probability, as such and adjusted within the feature."""
    sums, whole = rank_sums(long, [feature], group)
    one = sums.select(feature, F.col(group).alias("group1"), F.col("n").alias("n1"), (F.col("rank_sum") / F.col("n")).alias("r1"))
    two = sums.select(feature, F.col(group).alias("group2"), F.col("n").alias("n2"), (F.col("rank_sum") / F.col("n")).alias("r2"))
    n = F.col("total").cast("double")
    spread = (n * (n + 1) / 12 - F.col("tie_term") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    pairs = one.join(two, feature).where("group1 < group2").join(whole, feature)
    scored = pairs.select(feature, "group1", "group2", ratio(F.col("r1") - F.col("r2"), F.sqrt(spread)).alias("z")).withColumn("p", special.normal_p("z"))
    return adjusted(scored, by=[feature], how=how)


def screened_dunn(long: DataFrame, group: str, alpha: float = 0.05, feature: str = "feature", how: str = "fdr_bh") -> DataFrame:
    """Dunn's pairs of the features that Kruskal-Wallis finds to differ."""
    differing = kruskal(long, group, feature).where(F.col("p") < alpha).select(feature)
    return dunn(long, group, feature, how).join(differing, feature, "left_semi")


def dunn_effects(long: DataFrame, group: str, alpha: float = 0.05, feature: str = "feature", how: str = "fdr_bh") -> DataFrame:
    """Adjusted probability and Cliff's delta of every pair of groups, of the features that differ."""
    pairs = screened_dunn(long, group, alpha, feature, how).select(feature, "group1", "group2", "p_adj")
    return pairs.join(cliffs_delta_pairs(long, group, feature), [feature, "group1", "group2"]).withColumn("pair", F.concat_ws(" vs ", "group1", "group2"))


def mann_whitney(long: DataFrame, side: str, control: str, treated: str, by: list[str]) -> DataFrame:
    """U of the control side, its probability with continuity correction, and Cliff's delta, within ``by``."""
    sums, whole = rank_sums(long, by, side)

    def of(which: str, column: str) -> Column:
        return F.max(F.when(F.col(side) == which, F.col(column)))

    wide = sums.groupBy(*by).agg(of(control, "n").alias("n1"), of(treated, "n").alias("n2"), of(control, "rank_sum").alias("r1")).join(whole, by)
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("total").cast("double")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("tie_term") / (n * (n - 1))))
    half = F.col("n1") * F.col("n2") / 2
    z = ratio(F.greatest(F.abs(u - half) - 0.5, F.lit(0.0)), spread)
    out = wide.select(*by, "n1", "n2", u.alias("u"), ratio(2 * u, F.col("n1") * F.col("n2")).alias("_d"), z.alias("z"))
    return out.select(*by, "n1", "n2", "u", (F.col("_d") - 1).alias("delta"), "z", special.normal_p("z").alias("p"))


def cliffs_delta_pairs(long: DataFrame, group: str, feature: str = "feature") -> DataFrame:
    """Cliff's delta of every pair of groups, the smaller first, by feature.

    Ranks are taken within each pair over the distinct values of its two groups.
    """
    counts = long.where("value is not null").groupBy(feature, group, "value").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(feature, group).distinct()
    pairs = (
        groups.withColumnRenamed(group, "group1").join(groups.withColumnRenamed(group, "group2"), feature).where("group1 < group2")
    )
    sided = pairs.select(feature, "group1", "group2", F.explode(F.array("group1", "group2")).alias(group)).join(counts, [feature, group])
    by = [feature, "group1", "group2"]
    values = sided.groupBy(*by, "value").agg(
        F.sum(F.when(F.col(group) == F.col("group1"), F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col(group) == F.col("group2"), F.col("n")).otherwise(0)).alias("n2")
    )
    # values of the second group below each value, less those above
    won = F.col("n1") * (2 * F.col("_below") - F.col("n2"))
    scored = running_sum(values, by, "value", "n2", "_below").withColumn("won", won)
    return scored.groupBy(*by).agg((F.sum("won") / (F.sum("n1") * F.sum("n2")) - 1).alias("delta"))


def partners(pairs: DataFrame, alpha: float, feature: str = "feature", p: str = "p_adj") -> DataFrame:
    """By feature and group: from how many others it differs, which, and how that is called."""
    both = pairs.select(feature, F.col("group1").alias("group"), F.col("group2").alias("other"), p).unionByName(
        pairs.select(feature, F.col("group2").alias("group"), F.col("group1").alias("other"), p)
    )
    differs = F.col(p) < alpha
    counted = both.groupBy(feature, "group").agg(F.count(F.when(differs, 1)).alias("n"), F.sort_array(F.collect_list(F.when(differs, F.col("other")))).alias("others"))
    kind = F.when(F.col("n") >= 2, "differs_from_both").when(F.col("n") == 1, "differs_from_exactly_one").otherwise("differs_from_none")
    return counted.withColumn("category", kind)


def topology(pairs: DataFrame, alpha: float, feature: str = "feature", p: str = "p_adj") -> DataFrame:
    """How a feature's groups differ, the pairs that do, and the number of groups.

    ``all_differ``: every group from every other; one or two ``differ_from_all``, and the
    rest from them alone; ``only_pairwise``: none from more than one; else ``mixed``.
    """
    groups = partners(pairs, alpha, feature, p)
    k = groups.groupBy(feature).agg(F.count(F.lit(1)).alias("n_groups"))
    n, others = F.col("n"), F.col("n_groups") - 1
    counts = groups.join(k, feature).groupBy(feature, "n_groups").agg(
        F.max("n").alias("most"), F.count(F.when(n == others, 1)).alias("full"), F.count(F.when((n > 1) & (n < others), 1)).alias("between"), F.count(F.when(n == 1, 1)).alias("single")
    )
    led = (F.col("between") == 0) & (F.col("single") == F.col("n_groups") - F.col("full"))
    kind = (
        F.when(F.col("full") == F.col("n_groups"), "all_differ")
        .when(led & (F.col("full") == 1), "one_differ_from_all")
        .when(led & (F.col("full") == 2), "two_differ_from_all")
        .when(F.col("most") <= 1, "only_pairwise")
        .otherwise("mixed")
    )
    found = pairs.groupBy(feature).agg(F.sort_array(F.collect_list(F.when(F.col(p) < alpha, F.concat_ws(" vs ", "group1", "group2")))).alias("differing"))
    return counts.select(feature, "n_groups", kind.alias("topology")).join(found, feature)


def all_or_none(pairs: DataFrame, alpha: float, feature: str = "feature", p: str = "p_adj") -> DataFrame:
    """Whether all, none or part of a feature's pairs differ."""
    ends = pairs.groupBy(feature).agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    return ends.select(feature, F.when(F.col("hi") < alpha, "all").when(F.col("lo") >= alpha, "none").otherwise("partial").alias("extent"))


def difference_counts(found: DataFrame, rows: list[str], columns: list[str], group: str, target: str = "all", feature: str = "feature") -> DataFrame:
    """Features by the keywords of their names, a row for each of ``rows`` and a column for each of ``columns``.

    ``found`` are ``partners``.  Counted are features where the group differs from several
    others (``all``), from none (``none``), or from the group ``target`` alone.
    """
    category, others = F.col("category"), F.col("others")
    wanted = {"all": category == "differs_from_both", "none": category == "differs_from_none"}.get(
        target, (category == "differs_from_exactly_one") & F.array_contains(others.cast("array<string>"), target)
    )
    names = found.where((F.col("group").cast("string") == group) & wanted).select(feature).distinct()
    counts = [F.count(F.when(F.col(feature).contains(F.col("row")) & F.col(feature).contains(c), 1)).alias(c) for c in columns]
    lines = found.sparkSession.createDataFrame([(r,) for r in rows], "row string")
    # the lines are the handful of keywords given
    return lines.join(names, F.col(feature).contains(F.col("row")), "left").groupBy("row").agg(*counts)


def moments(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return long.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def welch(long: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Welch's t, degrees of freedom and probability, as such and adjusted, for every pair of groups of two and more, within ``by``."""
    stats = moments(long, [*by, group]).where("n >= 2")
    one = stats.select(*by, F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    two = stats.select(*by, F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    pairs = (one.join(two, by) if by else one.join(two)).where("group1 < group2")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df = ratio((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    out = pairs.select(*by, "group1", "group2", ratio(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2)).alias("t"), df.alias("df"))
    return adjusted(out.withColumn("p", special.t_p("t", "df")), by=by)


def anova(long: DataFrame, group: str, by: list[str]) -> DataFrame:
    """One-way F within ``by``."""
    stats = moments(long, [*by, group]).where("n > 0")
    n, mean = F.col("n"), F.col("mean")
    sums = stats.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n * mean * mean).alias("q"), F.sum(n * mean).alias("s"), F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (n - 1)).alias("within")
    )
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = ratio(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    out = sums.select(*by, (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), f.alias("f"))
    return out.withColumn("p", special.f_p("f", "df1", "df2"))


def levene(long: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Levene's W about the medians, within ``by``."""
    keys = [*by, group]
    medians = quantiles(long, keys, "value", {"_m": 0.5})
    moved = long.join(medians, keys).select(*keys, F.abs(F.col("value") - F.col("_m")).alias("value"))
    return anova(moved, group, by).withColumnRenamed("f", "w")


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Observed and expected counts with Pearson and adjusted residuals, a row for each cell."""
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(row).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("column_n"))
    whole = cells.agg(F.sum("n").alias("total"))
    grid = rows.crossJoin(columns).crossJoin(F.broadcast(whole))  # a row for every cell of the table; one row
    full = grid.join(cells, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    expected = F.col("row_n") * F.col("column_n") / F.col("total")
    residual = (F.col("n") - expected) / F.sqrt(expected)
    adjusted = ratio(residual, F.sqrt((1 - F.col("row_n") / F.col("total")) * (1 - F.col("column_n") / F.col("total"))))
    return full.select(row, column, "n", expected.alias("expected"), residual.alias("residual"), adjusted.alias("adjusted"), "total")


def cramers_v(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-squared, degrees of freedom, probability and Cramer's V of two columns."""
    cells = contingency(df, row, column)
    sums = cells.agg(F.sum(F.col("residual") * F.col("residual")).alias("chi2"), F.max("total").alias("total"), F.count_distinct(row).alias("r"), F.count_distinct(column).alias("c"))
    least = F.least(F.col("r"), F.col("c")) - 1
    out = sums.select("chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.sqrt(ratio(F.col("chi2"), F.col("total") * least)).alias("v"))
    return out.withColumn("p", special.chi2_p("chi2", "df"))


def two_by_two(counts: DataFrame, by: list[str], fisher_below: float = 5.0) -> DataFrame:
    """Chi-squared without correction of the columns a, b, c, d, odds ratio, and the test's probability.

    Fisher's exact test takes its place where an expected count is small.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    chi2 = ratio(n * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    least = F.least((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / n
    out = counts.select(*by, "a", "b", "c", "d", chi2.alias("chi2"), ratio(a * d, b * c).alias("odds"), (least < fisher_below).alias("exact"), (ratio(a, a + b) - ratio(c, c + d)).alias("difference"))
    return out.withColumn("p", F.when(F.col("exact"), special.fisher_p("a", "b", "c", "d")).otherwise(special.chi2_p("chi2", F.lit(1))))


def two_proportions(counts: DataFrame, by: list[str]) -> DataFrame:
    """z of the difference between two shares, x1 of n1 and x2 of n2."""
    x1, n1, x2, n2 = (F.col(c).cast("double") for c in ("x1", "n1", "x2", "n2"))
    pooled = (x1 + x2) / (n1 + n2)
    z = ratio(x1 / n1 - x2 / n2, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)))
    return counts.select(*by, "x1", "n1", "x2", "n2", z.alias("z")).withColumn("p", special.normal_p("z"))


def wilson(x: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Ends of Wilson's interval for a share."""
    p = x / n
    middle = p + z * z / (2 * n)
    reach = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (middle - reach) / scale, (middle + reach) / scale


def adjusted(df: DataFrame, p: str = "p", by: list[str] = [], how: str = "fdr_bh", out: str = "p_adj") -> DataFrame:  # noqa: B006
    """Probabilities adjusted for their number within ``by``: fdr_bh, fdr_by, holm or bonferroni.

    Null probabilities don't count and stay null.
    """
    frame = Window.partitionBy(*by)
    known = F.col(p).isNotNull()
    m = F.count(p).over(frame)
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p))
    ranked = df.withColumns({"_m": m, "_k": rank})
    last = Window.partitionBy(*by, known).orderBy(F.col("_k").desc())
    first = Window.partitionBy(*by, known).orderBy("_k")
    if how == "bonferroni":
        value = F.col(p) * F.col("_m")
    elif how == "holm":
        value = F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(first)
    else:
        harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_m"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / k) if how == "fdr_by" else F.lit(1.0)
        value = F.min(F.col(p) * F.col("_m") / F.col("_k") * harmonic).over(last)
    return ranked.withColumn(out, F.when(known, F.least(value, F.lit(1.0)))).drop("_m", "_k")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, the earlier first; one pass."""
    pairs = [
        F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.corr(a, b).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]
    ]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def correlated(pairs: DataFrame, strong: float = 0.7, extreme: float = 0.9) -> DataFrame:
    """Pairs of at least a strong correlation of either sign, marked with sign and strength."""
    size = F.abs(F.col("r"))
    return pairs.where(size >= strong).withColumns({"sign": F.when(F.col("r") > 0, "positive").otherwise("negative"), "strength": F.when(size >= extreme, "extreme").otherwise("strong")})


def dispersion(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population skewness, variation, median absolute deviation and Gini index by group."""
    # all but the moments is worked out from the counts of values
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    # equal values share the mean of their places
    gini = running_sum(counts, by, "_v", "_n", "_below").withColumn("_place", F.col("_below") - (F.col("_n") - 1) / 2).groupBy(*by).agg(
        ratio(2 * F.sum(F.col("_place") * F.col("_n") * F.col("_v")), F.sum("_n") * F.sum(F.col("_n") * F.col("_v"))).alias("_g"), F.sum("_n").alias("_all")
    )
    basics = df.groupBy(*by).agg(F.skewness(value).alias("skew"), ratio(F.stddev_pop(value), F.avg(value)).alias("cv"))
    medians = cut(quantiles(counts, by, "_v", {"_med": 0.5}, times="_n").join(counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by))
    mads = quantiles(joined_unskewed(counts, medians, by), by, F.abs(F.col("_v") - F.col("_med")), {"mad": 0.5}, times="_n")
    return basics.join(mads, by).join(gini, by).select(*by, "skew", "cv", "mad", (F.col("_g") - (F.col("_all") + 1) / F.col("_all")).alias("gini"))


@F.pandas_udf(StructType([StructField("low", LongType()), StructField("high", LongType())]))
def _two_ranks(n: pd.Series, at: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """Ranks, in a sample of ``n``, of the values at places ``at`` and ``at + 1`` (from one) of a replicate."""
    low, high = np.empty(len(n)), np.empty(len(n))
    for i, (size, k, s) in enumerate(zip(n, at, seed)):
        draw = np.random.default_rng(int(s) & (2**63 - 1))
        low[i] = draw.beta(k, size - k + 1)
        high[i] = low[i] + (1 - low[i]) * draw.beta(1, size - k) if k < size else low[i]
    every = n.to_numpy()
    return pd.DataFrame({name: np.minimum(np.floor(u * every).astype(np.int64) + 1, every) for name, u in (("low", low), ("high", high))})


def bootstrap_quantile(df: DataFrame, group: str, value: str, q: float = 0.75, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Interpolated quantile of each bootstrap replicate of each group.

    The k-th value of a replicate of ``n`` rows drawn with replacement is the value at the
    k-th of ``n`` ordered uniform numbers, which has a beta distribution.  So the two values
    about the quantile are drawn at once, from a hash of group and replicate, and no row
    is drawn: a replicate costs two lookups in the distinct values of its group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.lit(q) * (F.col("_all") - 1)
    drawn = (
        counts.groupBy(group)
        .agg(F.sum("_n").alias("_all"))
        .select(group, "_all", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), (place - F.floor(place)).alias("_share"), (F.floor(place) + 1).alias("_k"))
        .withColumn("_r", _two_ranks("_all", "_k", F.xxhash64(group, "replicate", F.lit(seed))))
    )
    ends = F.array(F.struct(F.col("_r.low").alias("rank"), (1 - F.col("_share")).alias("w")), F.struct(F.col("_r.high").alias("rank"), F.col("_share").alias("w")))
    ends = cut(drawn.select(group, "replicate", F.inline(ends)))
    wanted = ends.groupBy(group).agg(F.collect_set("rank").alias("_ranks"))  # at most two a replicate
    below = F.col("_upto") - F.col("_n")
    held = running_sum(counts, [group], "_v", "_n", "_upto").join(wanted, group)
    found = held.select(group, "_v", F.explode(F.filter("_ranks", lambda r: (r > below) & (r <= F.col("_upto")))).alias("rank"))
    return ends.join(found, [group, "rank"]).groupBy(group, "replicate").agg(F.sum(F.col("w") * F.col("_v")).alias("quantile"))


def bootstrap_differences(replicates: DataFrame, group: str) -> DataFrame:
    """Two-sided probability that two groups' quantiles don't differ, for every pair, the smaller first."""
    one = replicates.select("replicate", F.col(group).alias("group1"), F.col("quantile").alias("_q1"))
    two = replicates.select("replicate", F.col(group).alias("group2"), F.col("quantile").alias("_q2"))
    less, more = F.avg((F.col("_q1") <= F.col("_q2")).cast("double")), F.avg((F.col("_q1") >= F.col("_q2")).cast("double"))
    return one.join(two, "replicate").where("group1 < group2").groupBy("group1", "group2").agg((2 * F.least(less, more)).alias("p"))


def compared_proportions(df: DataFrame, group: str, condition: str, first: str, second: str, how: str = "holm") -> DataFrame:
    """By group: its count and share in two conditions, the difference, odds ratio, and Fisher's probability, adjusted.

    The table behind each is the group against all other groups.
    """
    one, two = F.col(condition) == first, F.col(condition) == second
    counts = df.where(one | two).groupBy(group).agg(F.count(F.when(one, 1)).alias("count1"), F.count(F.when(two, 1)).alias("count2"))
    whole = counts.agg(F.sum("count1").alias("_n1"), F.sum("count2").alias("_n2"))
    tables = counts.join(F.broadcast(whole)).withColumns({"_b": F.col("_n1") - F.col("count1"), "_d": F.col("_n2") - F.col("count2")})  # one row
    share1, share2 = ratio(F.col("count1"), F.col("_n1")), ratio(F.col("count2"), F.col("_n2"))
    out = tables.select(
        group, "count1", "count2", share1.alias("share1"), share2.alias("share2"), (share2 - share1).alias("difference"),
        F.when(share2 > share1, "larger").when(share2 < share1, "smaller").otherwise("same").alias("direction"),
        ratio(F.col("count1").cast("double") * F.col("_d"), F.col("_b") * F.col("count2")).alias("odds"), special.fisher_p("count1", "_b", "count2", "_d").alias("p"),
    )
    return adjusted(out, how=how)


def feature_table(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Long form with missing values left out."""
    return long_form(df, ids, columns).where("value is not null")


def tukey(long: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Tukey-Kramer range statistic and probability of every pair of groups, within ``by``."""
    stats = moments(long, [*by, group]).where("n > 0")
    pooled = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"), (F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)) / (F.sum("n") - F.count(F.lit(1)))).alias("ms")
    )
    one = stats.select(*by, F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    two = stats.select(*by, F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    pairs = one.join(two, by).where("group1 < group2").join(pooled, by)
    q = ratio(F.abs(F.col("m1") - F.col("m2")), F.sqrt(F.col("ms") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))))
    return pairs.select(*by, "group1", "group2", "k", "df", q.alias("q")).withColumn("p", special.range_p("q", "k", "df"))


def two_way_anova(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Two-way analysis of variance of type II: F of each factor and of their interaction.

    Rows are summed by cell in Spark; the models are fitted to the cells, as many as the
    factors have levels.
    """
    cells = df.dropna(subset=[a, b, value]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    rows = cells.orderBy(a, b).collect()
    n, mean = np.array([r.n for r in rows], float), np.array([r.mean for r in rows])
    within = float(sum(r.n * r.var for r in rows))
    levels = [sorted({r[c] for r in rows}) for c in (a, b)]
    dummies = [np.array([[float(r[c] == v) for v in lv[1:]] for r in rows]).reshape(len(rows), -1) for c, lv in zip((a, b), levels)]

    def left(*parts: np.ndarray) -> tuple[float, int]:
        """Sum of squares that a model leaves, and its parameters."""
        x = np.hstack([np.ones((len(rows), 1)), *parts]) * np.sqrt(n)[:, None]
        y = mean * np.sqrt(n)
        fit, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return within + float(((y - x @ fit) ** 2).sum()), int(rank)

    both, only_a, only_b = left(*dummies), left(dummies[0]), left(dummies[1])
    free = int(n.sum()) - len(rows)
    out = []
    for name, (rss, rank), (less, fewer) in ((a, both, only_b), (b, both, only_a), (f"{a}:{b}", (within, len(rows)), both)):
        df1 = rank - fewer
        f = (less - rss) / df1 / (within / free) if df1 and free and within else None
        out.append((name, float(less - rss), df1, free, f))
    found = df.sparkSession.createDataFrame(out, "factor string, squares double, df1 int, df2 int, f double")
    return found.withColumn("p", special.f_p("f", "df1", "df2"))


def line_and_condition(df: DataFrame, line: str, condition: str, value: str, how: str = "holm") -> DataFrame:
    """Welch tests between conditions within each line and between lines within each condition, adjusted together."""
    within = welch(df.select(line, condition, F.col(value).alias("value")), condition, [line]).withColumn("family", F.lit("within_line")).withColumnRenamed(line, "at")
    between = welch(df.select(line, condition, F.col(value).alias("value")), line, [condition]).withColumn("family", F.lit("between_lines")).withColumnRenamed(condition, "at")
    both = within.withColumn("at", F.col("at").cast("string")).unionByName(between.withColumn("at", F.col("at").cast("string")))
    return adjusted(both.drop("p_adj"), how=how)


def binned_density(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Rows in each cell of a grid over the range of two columns."""
    ends = df.agg(*[f(c).alias(f"{n}{c}") for c in (x, y) for n, f in (("lo_", F.min), ("hi_", F.max))])

    def place(c: str) -> Column:
        share = ratio(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")

    return df.join(F.broadcast(ends)).groupBy(place(x).alias("bin_x"), place(y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))  # one row


def kernel_density(points: DataFrame, width: float, key: str = "id", reach: float = 4.0) -> DataFrame:
    """Gaussian density at every point, from the points within so many widths."""
    from mensura.operators.joins import within_radius

    n = points.agg(F.count(F.lit(1)).alias("_n"))
    pairs = within_radius(points, width * reach, key)
    weight = F.exp(-F.col("distance") * F.col("distance") / (2 * width * width))
    both = pairs.select(F.col("a").alias(key), weight.alias("w")).unionByName(pairs.select(F.col("b").alias(key), weight.alias("w")))
    sums = both.groupBy(key).agg(F.sum("w").alias("w"))
    scale = F.col("_n") * 2 * F.pi() * width * width
    return points.select(key).join(sums, key, "left").join(F.broadcast(n)).select(key, ((F.coalesce("w", F.lit(0.0)) + 1) / scale).alias("density"))  # one row
