"""Cutting the lineage of iterative jobs in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on a single machine only."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


def run_once(df: DataFrame) -> DataFrame:
    """``df``, whose shuffle files go when an action on it ends; writing to tables and files is none of these.

    Otherwise they stay until the driver collects its garbage, so that those of many jobs
    lie on disk together.  A second action on the same frame would make them again.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FILES_GO, None)
    conf.set(_FILES_GO, "true")
    try:
        return df.select("*")  # the setting counts as it is when a frame is made
    finally:
        conf.unset(_FILES_GO) if before is None else conf.set(_FILES_GO, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from what was written."""
    checkpoint_root(df.sparkSession)
    return run_once(df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again.

    A checkpoint keeps what the plan knew of its columns, which doubles from round to round
    where rows are joined with themselves and computed on; what is read knows nothing.
    """
    path = f"{checkpoint_root(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
