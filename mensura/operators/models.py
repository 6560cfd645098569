"""Generalised linear models of counts."""

from __future__ import annotations

from pyspark.errors import UnsupportedOperationException
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binomial_model(df: DataFrame, terms: str, events: str, others: str) -> tuple[DataFrame, DataFrame]:
    """Logit model of the share of ``events`` among ``events`` and ``others`` on the terms of a formula.

    Returns the coefficients, a row for each ``term`` with ``estimate``, standard ``error``,
    ``z`` and two-sided ``p``, and the rows with their ``fitted`` share.  Rows without
    counts or with a null count fall out.  Where terms depend on each other linearly the
    coefficients are one choice of many, and error, z and p are null.
    """
    counted = df.withColumn("_n", (F.col(events) + F.col(others)).cast("double")).where("_n > 0").withColumn("share_", F.col(events) / F.col("_n"))
    table = RFormula(formula=f"share_ ~ {terms}", featuresCol="_features", labelCol="_label").fit(counted).transform(counted)
    model = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="_n", featuresCol="_features", labelCol="_label", predictionCol="fitted", tol=1e-10, maxIter=100).fit(table)
    named = {a["idx"]: a["name"] for kind in table.schema["_features"].metadata["ml_attr"]["attrs"].values() for a in kind}
    names = [named[i] for i in range(len(named))] + ["intercept"]
    found = model.summary
    estimates = [*model.coefficients.tolist(), model.intercept]
    try:
        tests = [found.coefficientStandardErrors, found.tValues, found.pValues]
    except UnsupportedOperationException:  # a singular design
        tests = [[None] * len(names)] * 3
    rows = list(zip(names, estimates, *tests))  # a row for each term
    coefficients = df.sparkSession.createDataFrame(rows, "term string, estimate double, error double, z double, p double")
    return coefficients, model.transform(table).select(*df.columns, "fitted")
