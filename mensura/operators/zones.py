"""Where the objects of an image lie: zones about structures, flags of context, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.columns import ratio
from mensura.operators.joins import nearest
from mensura.operators.voxels import PLACE, combined, dilated, eroded


def distance_to_mask(points: DataFrame, mask: DataFrame, width: float = 8.0, key: str = "id") -> DataFrame:
    """Distance of each point ``image, id, x, y`` to the nearest place of its image's mask; null where that is empty."""
    found = nearest(points, "image", width, key, mask.select("image", "x", "y")).select("image", F.col("a").alias(key), "distance")
    return points.select("image", key).join(found, ["image", key], "left")


def around(mask: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """A structure with all places within the radius."""
    return dilated(mask, width, height, "square", radius)


def rim(mask: DataFrame, radius: int) -> DataFrame:
    """Places of a structure within the radius of its edge."""
    return combined(mask, eroded(mask, "square", radius), "subtract")


def context_flags(labels: DataFrame, zones: dict[str, DataFrame], members: dict[str, DataFrame] = {}) -> DataFrame:  # noqa: B006
    """A row for each label with 0 or 1 by name: whether it reaches into the zone, or is one of the members ``image, label``."""
    named = [z.select(*PLACE).distinct().withColumn("_zone", F.lit(n)) for n, z in zones.items()]
    found = labels.select("image", "label").distinct().withColumn("_zone", F.lit(""))
    for zone in named:
        found = found.unionByName(labels.join(zone, PLACE).select("image", "label", "_zone"))
    for name, rows in members.items():
        found = found.unionByName(rows.select("image", "label", F.lit(name).alias("_zone")))
    return found.groupBy("image", "label").agg(*[F.max((F.col("_zone") == n).cast("int")).alias(n) for n in (*zones, *members)])


def exclusive_flags(nucleus: str, edge: str) -> dict[str, Column]:
    """Flags of objects at neither, at one alone, and at both."""
    n, e = F.col(nucleus) == 1, F.col(edge) == 1
    return {c: v.cast("int") for c, v in {"cytoplasm": ~n & ~e, f"{edge}_only": e & ~n, f"{nucleus}_only": n & ~e, "squished": n & e}.items()}


def zone_density(labels: DataFrame, zone: DataFrame) -> DataFrame:
    """By image: labels that reach into the zone, its area, their number by area, and their share of all labels."""
    zone = zone.select(*PLACE).distinct()
    areas = zone.groupBy("image").agg(F.count(F.lit(1)).alias("area"))
    flags = context_flags(labels, {"inside": zone}).groupBy("image").agg(F.sum("inside").alias("n"), F.count(F.lit(1)).alias("labels"))
    both = areas.join(flags, "image", "full").select("image", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "area", "labels")])
    return both.select("image", "n", "area", ratio(F.col("n"), F.col("area")).alias("density"), ratio(F.col("n"), F.col("labels")).alias("share"))


def with_density(rows: DataFrame, labels: DataFrame, zone: DataFrame) -> DataFrame:
    """Rows with the density and share of their image, worked out once an image."""
    return rows.join(zone_density(labels, zone).select("image", "density", "share"), "image", "left")
