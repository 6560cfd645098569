"""Labelled regions: gluing of small ones, distances to a cell's inscribed circle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions.lineage import cut
from mensura.operators.components import least_member
from mensura.operators.tiles import deepest
from mensura.operators.voxels import PLACE


def glued(labels: DataFrame, least: int, most: int, reach: int = 3) -> DataFrame:
    """The region that each ``image``, ``label`` becomes part of, named in ``glued`` by its least label.

    Regions of an area over ``least`` and below ``most`` are small and look for others
    within the distance ``reach`` of their places, inside their bounding box.  A small
    region with one neighbour joins it, whatever its size; with several it joins those
    that are small, if these are two and more; otherwise it stays.  What this links is one
    region, in any order of the rules.  Repeated places count once.
    """
    places = labels.select(*PLACE, "label").dropna().distinct()
    box = [F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")]
    sizes = cut(places.groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"), *box))
    small = sizes.where((F.col("area") > least) & (F.col("area") < most))
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy * dy + dx * dx <= reach * reach]
    disc = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("_s")
    spread = places.join(small, ["image", "label"]).select("*", disc).withColumns({"y": F.col("y") + F.col("_s.dy"), "x": F.col("x") + F.col("_s.dx")})
    about = spread.where("y between y0 and y1 and x between x0 and x1").select(*PLACE, F.col("label").alias("a")).distinct()
    touching = about.join(places.withColumnRenamed("label", "b"), PLACE).where("a <> b").select("image", "a", "b").distinct()
    known = cut(touching.join(small.select("image", F.col("label").alias("b"), F.lit(True).alias("little")), ["image", "b"], "left"))
    counts = known.groupBy("image", "a").agg(F.count(F.lit(1)).alias("n"), F.count("little").alias("n_small"))
    links = known.join(counts, ["image", "a"]).where("n = 1 or (n_small > 1 and little)")
    name = {side: F.struct("image", F.col(side).alias("label")) for side in ("a", "b", "label")}
    roots = least_member(sizes.select(name["label"].alias("id")), links.select(name["a"].alias("a"), name["b"].alias("b")))
    return roots.select("id.image", "id.label", F.col("root.label").alias("glued"))


def inscribed_distances(cells: DataFrame, objects: DataFrame, width: int, height: int) -> DataFrame:
    """How far objects are from the centre of the largest circle inside each image's cell.

    Returns for each image with a cell the centre ``cy, cx``, of equal ones the first by
    rows, the ``radius``, the number of labelled ``objects``, and as means over these the
    ``centroid_distance`` and, by their nearest place, ``nearest_distance``; zero without
    objects.
    """
    centres = cut(deepest(cells, width, height).select("image", F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("depth").alias("radius")))

    def away(y, x):
        return F.sqrt(F.pow(y - F.col("cy"), 2) + F.pow(x - F.col("cx"), 2))

    each = objects.join(centres, "image").groupBy("image", "label", "cy", "cx").agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"), F.min(away(F.col("y"), F.col("x"))).alias("_near"))
    means = each.groupBy("image").agg(F.count(F.lit(1)).alias("objects"), F.avg(away(F.col("_y"), F.col("_x"))).alias("centroid_distance"), F.avg("_near").alias("nearest_distance"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("centroid_distance", "nearest_distance")}
    return centres.join(means, "image", "left").withColumns({"objects": F.coalesce("objects", F.lit(0)), **zero})
