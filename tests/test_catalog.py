"""Every query against the same in DuckDB on the smallest tables, and on its own where SQL can't say it."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from mensura.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SLOW = {"gap_statistic"}  # fits many models
MAY_BE_EMPTY = {"mask_holes"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def near(a, b):
    return a == b or (isinstance(a, float | int) and isinstance(b, float | int) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    own = table(found.columns, [tuple(r) for r in found.collect()])
    cursor = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    other = table(names, cursor.fetchall())
    assert len(own) == len(other)
    for a, b in zip(own, other):
        assert all(map(near, a, b)), (a, b)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL and n not in SLOW])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0 or name in MAY_BE_EMPTY


def test_mask_algebra_counts_empty_results(spark, tmp_path):
    # a mask that is its own mirror image: nothing is left to subtract
    rows = [(8 * y, x, 1.0) for y in range(2) for x in (0, 63)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.how: r.n for r in catalog.QUERIES["mask_algebra"](spark, str(tmp_path)).collect()}
    assert found == {"and": 4, "or": 4, "subtract": 0, "xor": 0}
