"""The driver's tables in the shapes that measurement analysis has: Spark frames and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.sources.tables import table

MEASURES = ["quantity", "price", "discount", "tax"]
ORGANELLES = ["nucleus", "golgi", "lysosome", "er"]
KINDS = ["area", "shape", "texture"]

OBJECTS = """objects AS (
  SELECT l_suppkey AS cell, l_linenumber AS image, l_orderkey AS order_id, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax, l_returnflag AS subtype, l_linestatus AS condition
  FROM lineitem)"""

FEATURES = OBJECTS + """, features AS (
  SELECT cell, subtype, condition, 'quantity' AS feature, quantity AS value FROM objects
  UNION ALL SELECT cell, subtype, condition, 'discount', discount FROM objects
  UNION ALL SELECT cell, subtype, condition, 'tax', tax FROM objects)"""

TRACKS = """tracks AS (
  SELECT user_id AS cell, event_type AS line, CAST(floor((epoch(ts) - 1704067200) / 86400) AS BIGINT) AS frame, value,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS label
  FROM events)"""

POINTS = """points AS (
  SELECT vec_id AS id, label AS cell, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""

MASK = """mask AS (
  SELECT DISTINCT l_orderkey % 8 AS image, (l_orderkey // 8) % 64 AS y, l_partkey % 64 AS x FROM lineitem WHERE l_quantity <= 3)"""


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each object: its cell, image, measures, subtype and condition."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("image"), F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("subtype"),
        F.col("l_linestatus").alias("condition"),
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Measures in long form."""
    from mensura.operators.reshape import long_form

    return long_form(objects(spark, folder), ["cell", "subtype", "condition"], ["quantity", "discount", "tax"])


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of cells over time: a frame is a day."""
    day = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 86400).cast("long")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("cell"), F.col("event_type").alias("line"), day.alias("frame"), "value", F.regexp_extract("props", r"(\d+)", 1).try_cast("long").alias("label")
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cell"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


def mask(spark: SparkSession, folder: str) -> DataFrame:
    """A thin mask: eight images of 64 by 64 places."""
    return (
        table(spark, folder, "lineitem")
        .where("l_quantity <= 3")
        .selectExpr("l_orderkey % 8 AS image", "(l_orderkey div 8) % 64 AS y", "l_partkey % 64 AS x")
        .distinct()
    )


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as feature vectors with their label."""
    from pyspark.ml.functions import array_to_vector

    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("given"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show; no negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


PROFILES = """profiles AS (
  SELECT label AS subtype, ['nucleus', 'golgi', 'lysosome', 'er'][i % 4 + 1] || '_' || ['area', 'shape', 'texture'][i % 3 + 1] || '_' || i AS feature, value
  FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings))"""


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as measures of organelles, in long form; their labels are subtypes."""
    flat = table(spark, folder, "embeddings").select(F.col("label").alias("subtype"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value"))
    organelle = F.element_at(F.array(*map(F.lit, ORGANELLES)), F.col("i") % 4 + 1)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("i") % 3 + 1)
    return flat.select("subtype", F.concat_ws("_", organelle, kind, "i").alias("feature"), "value")


def normal_p(z: str) -> str:
    """SQL of the two-sided normal probability, by Simpson's rule."""
    weight = "(CASE WHEN i IN (0, 600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, 601), lambda i: {weight} * exp(-pow(abs({z}) + i * 0.015, 2) / 2))) * 0.01 / sqrt(2 * pi()))"


def chi2_p(x: str, df: str) -> str:
    """SQL of the tail of chi-squared, by its finite sums."""
    even = f"exp(-({x}) / 2) * list_sum(list_transform(range(0, ({df}) // 2), lambda i: pow(({x}) / 2, i) / gamma(i + 1.0)))"
    odd = f"{normal_p(f'sqrt({x})')} + exp(-({x}) / 2) * coalesce(list_sum(list_transform(range(1, (({df}) - 1) // 2 + 1), lambda i: pow(({x}) / 2, i - 0.5) / gamma(i + 0.5))), 0)"
    return f"(CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def t_p(t: str, df: str) -> str:
    """SQL of the two-sided probability of Student's t, by Simpson's rule over the angle."""
    start, weight = f"atan(abs({t}) / sqrt({df}))", "(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    width = f"(least(pi() / 2, {start} + 15 / sqrt({df})) - {start})"
    return f"(2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * list_sum(list_transform(range(0, 1001), lambda i: {weight} * pow(greatest(cos({start} + i * {width} / 1000), 0), ({df}) - 1))) * {width} / 3000)"


def fisher_p(a: str, b: str, c: str, d: str) -> str:
    """SQL of the two-sided exact probability of a two by two table."""
    row, column, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"

    def choose(m: str, k: str) -> str:
        return f"(lgamma({m} + 1.0) - lgamma({k} + 1.0) - lgamma({m} - {k} + 1.0))"

    def p(k: str) -> str:
        return f"exp({choose(row, k)} + {choose(f'({n} - {row})', f'({column} - {k})')} - {choose(n, column)})"

    return f"least(1, list_sum(list_filter(list_transform(range(greatest(0, {row} + {column} - {n}), least({row}, {column}) + 1), lambda k: {p('k')}), lambda q: q <= {p(a)} * 1.0000001)))"


BLOBS = """blobs AS (
  SELECT DISTINCT image, y + dy AS y, x + dx AS x
  FROM (SELECT l_orderkey // 512 AS image, (l_orderkey * 31 + l_linenumber * 17) % 64 AS y, l_partkey * 7 % 64 AS x FROM lineitem WHERE l_quantity <= 3),
       (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)
  WHERE dy * dy + dx * dx <= 9 AND y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63)"""

PIXELS = """pixels AS (
  SELECT image, y, x, coalesce(value, 0) AS value
  FROM (SELECT * FROM (SELECT DISTINCT l_orderkey // 512 AS image FROM lineitem), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x))
  LEFT JOIN (SELECT l_orderkey // 512 AS image, (l_orderkey * 31 + l_linenumber * 17) % 64 AS y, l_partkey * 7 % 64 AS x, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY ALL) USING (image, y, x))"""


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr("l_orderkey div 512 AS image", "(l_orderkey * 31 + l_linenumber * 17) % 64 AS y", "l_partkey * 7 % 64 AS x", "l_quantity AS quantity")


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Discs that touch and overlap, in images of 64 by 64 places, whose number grows with the table."""
    from mensura.operators.voxels import dilated

    return dilated(_marks(spark, folder).where("quantity <= 3"), 64, 64, "disc", 3)


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Full images of 64 by 64 intensities, whose number grows with the table."""
    marks = _marks(spark, folder)
    places = F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))
    rows = marks.select("image").distinct().select("image", F.explode(places).alias("y"))
    held = marks.dropna(subset=["x"]).groupBy("image", "y", "x").agg(F.sum("quantity").cast("long").alias("value"))
    lines = held.groupBy("image", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "value"))).alias("values"))  # 64 at most
    grid = rows.join(lines, ["image", "y"], "left").select("image", "y", "values", F.explode(places).alias("x"))
    return grid.select("image", "y", "x", F.coalesce(F.col("values")[F.col("x")], F.lit(0)).alias("value"))
