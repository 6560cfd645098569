"""What cutting a lineage leaves on disk."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mensura.functions import lineage

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(path) for folder in folders for path in Path(folder.getPath()).rglob("shuffle_*")}


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_shuffle_files_go_with_the_job_that_made_them(spark, before):
    if before:
        spark.conf.set(SETTING, before)
    try:
        counts = spark.range(10000).groupBy((F.col("id") % 100).alias("k.1")).count()
        joined = counts.join(counts.select(F.col("`k.1`").alias("k"), F.col("count").alias("n")).hint("merge"), F.col("`k.1`") == F.col("k")).repartition(3, "k")
        old = shuffle_files(spark)
        rows = lineage.cut(joined)
        until = time.time() + 10
        while (left := shuffle_files(spark) - old) and time.time() < until:  # executors are told, not waited for
            time.sleep(0.2)
        assert not left
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, joined.collect())) == [(k, 100, k, 100) for k in range(100)]
        assert spark.conf.get(SETTING) == (before or "false")
    finally:
        spark.conf.unset(SETTING)
