"""Reading and writing measurement tables, path tables and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sheets(spark: SparkSession, folder: str, names: list[str], keywords: list[str] = [], how: str = "any") -> dict[str, DataFrame]:  # noqa: B006
    """Tables of a folder whose names hold any, all or none of the keywords."""
    return {n: table(spark, folder, n) for n in _matching(names, keywords, how)}


def sheets_of(spark: SparkSession, folder: str, keywords: list[str] = [], how: str = "any") -> dict[str, DataFrame]:  # noqa: B006
    """CSV files with a header of a folder, by name, whose names hold any, all or none of the keywords."""
    paths = [r.path for r in files(spark, folder, "*.csv").select("path").collect()]  # a row a file, contents unread
    named = {p.rsplit("/", 1)[-1].removesuffix(".csv"): p for p in sorted(paths)}
    return {n: spark.read.csv(named[n], header=True, inferSchema=True) for n in _matching(list(named), keywords, how)}


def chosen(sheets: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """The sheets of those names that there are, in the order given."""
    return {n: sheets[n] for n in names if n in sheets}


def _matching(names: list[str], keywords: list[str], how: str) -> list[str]:
    test = {"any": lambda n: not keywords or any(k in n for k in keywords), "all": lambda n: all(k in n for k in keywords), "none": lambda n: not any(k in n for k in keywords)}[how]
    return [n for n in names if test(n)]


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header, of a stated schema, with the file each row is from."""
    return spark.read.csv(path, header=True, schema=schema).withColumn("source_file", F.col("_metadata.file_name"))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder by name pattern: path, time of change and size."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")


def path_parts(path: Column) -> dict[str, Column]:
    """Host, kind, number and extension in a page's path."""
    return {
        "host": F.regexp_extract(path, r"://([^/?#]+)", 1),
        "part": F.regexp_extract(path, r"://[^/]+/([^/?#]+)", 1),
        "number": F.regexp_extract(path, r"/(\d+)", 1).try_cast("long"),
        "query": F.when(path.contains("?"), "query").when(path.contains("#"), "anchor").otherwise("plain"),
    }


def last_path(df: DataFrame, path: str, keyword: Column, order: str) -> DataFrame:
    """The last path, in a stated order, of each keyword that a pattern finds."""
    return df.withColumn("keyword", keyword).where("keyword <> ''").groupBy("keyword").agg(F.max_by(path, F.struct(order, path)).alias("path"))


def first_known(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key of several resumable results, each column from the first that has it."""
    tagged = [df.withColumn("_at", F.lit(i)) for i, df in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    values = [c for c in rows.columns if c not in (*keys, "_at")]
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in values])


def layers(df: DataFrame, cell: str, image: str, order: list[str]) -> DataFrame:
    """Object id of cell, layer of the image within it, and number within the layer."""
    layer = F.dense_rank().over(Window.partitionBy(cell).orderBy(image)) - 1
    number = F.row_number().over(Window.partitionBy(cell, image).orderBy(*order))
    return df.withColumns({"layer": layer, "number": number}).withColumn("object_id", F.concat_ws("_", cell, "layer", "number"))


def store(df: DataFrame, folder: str, by: list[str] = []) -> None:  # noqa: B006
    """Write a table as Parquet, in folders by column."""
    df.write.mode("overwrite").partitionBy(*by).parquet(folder)


def store_delimited(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, header=True)


def store_model(model, folder: str) -> None:
    model.write().overwrite().save(folder)
