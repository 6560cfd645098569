"""Column expressions for measurement tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(column: str) -> Column:
    """Missing measures are null: NaN never reaches an aggregate."""
    return F.nanvl(F.col(column), F.lit(None).cast("double"))


def number_or_null(column: str) -> Column:
    """Numeric reading of a text column; what is no number is null."""
    return F.col(column).try_cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return F.try_divide(top, bottom)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_mean(names: list[str]) -> Column:
    """Mean over the columns that are not null; null if all are."""
    held = total([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    return ratio(held, total([F.col(c).isNotNull().cast("int") for c in names]))


def share_of_row(names: list[str]) -> dict[str, Column]:
    """Each column as a share of the row's sum."""
    whole = total([F.col(c) for c in names])
    return {c: ratio(F.col(c), whole) for c in names}


def centred_log_ratio(names: list[str], floor: float = 1e-9) -> dict[str, Column]:
    """Logarithm of each share less the row's mean logarithm."""
    logs = {c: F.log(F.greatest(F.col(c), F.lit(floor))) for c in names}
    mean = total(list(logs.values())) / len(names)
    return {c: value - mean for c, value in logs.items()}


def adjusted_skewness(column: str) -> Column:
    """Sample skewness with the small-sample factor; null below three values."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def standard_error(column: str) -> Column:
    return F.stddev_samp(column) / F.sqrt(F.count(column))


def first_keyword(text: Column, keywords: dict[str, str], other: str) -> Column:
    """Value of the first keyword that the text holds, whatever its case."""
    chain = reduce(
        lambda e, kv: F.when(F.lower(text).contains(kv[0].lower()), kv[1]) if e is None else e.when(F.lower(text).contains(kv[0].lower()), kv[1]),
        keywords.items(),
        None,
    )
    return F.lit(other) if chain is None else chain.otherwise(other)


def display_name(text: Column) -> Column:
    """A feature name for display: underscores to spaces, each word with a capital."""
    return F.initcap(F.trim(F.regexp_replace(text, r"_+", " ")))


def circularity(area: Column, perimeter: Column) -> Column:
    return ratio(4 * F.pi() * area, perimeter * perimeter)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def bounded(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def entropy(probabilities: Column) -> Column:
    """Shannon entropy of an array of probabilities, in nats."""
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def margin(probabilities: Column) -> Column:
    """Largest less second largest of an array of probabilities."""
    down = F.sort_array(probabilities, asc=False)
    return F.element_at(down, 1) - F.element_at(down, 2)
