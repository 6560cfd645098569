"""Point patterns: spread, direction, spacing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions.columns import ratio
from mensura.operators.joins import nearest


def centred(points: DataFrame, by: str) -> DataFrame:
    """Points with their offset ``dx, dy`` from the mean of their group."""
    middle = points.groupBy(by).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    return points.join(middle, by).withColumns({"dx": F.col("x") - F.col("_cx"), "dy": F.col("y") - F.col("_cy")}).drop("_cx", "_cy")


def standard_distance(offsets: DataFrame, by: str) -> DataFrame:
    return offsets.groupBy(by).agg(F.sqrt(F.avg(F.col("dx") * F.col("dx")) + F.avg(F.col("dy") * F.col("dy"))).alias("distance"))


def deviational_ellipse(offsets: DataFrame, by: str) -> DataFrame:
    """Axes, rotation and axis ratio of the standard deviational ellipse."""
    sums = offsets.groupBy(by).agg(
        F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.count(F.lit(1)).alias("n")
    )
    angle = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    turned = sums.withColumn("theta", angle)
    c, s = F.cos("theta"), F.sin("theta")
    long = F.sqrt(2 * (F.col("xx") * c * c + 2 * F.col("xy") * c * s + F.col("yy") * s * s) / F.col("n"))
    short = F.sqrt(2 * F.greatest(F.col("xx") * s * s - 2 * F.col("xy") * c * s + F.col("yy") * c * c, F.lit(0.0)) / F.col("n"))
    return turned.select(by, long.alias("major"), short.alias("minor"), "theta", ratio(short, long).alias("ratio"))


def polarisation(offsets: DataFrame, by: str) -> DataFrame:
    """Length and direction of the mean of the unit vectors from the centre; points at it have none."""
    r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    unit = offsets.withColumn("_r", r).where("_r > 0")
    sums = unit.groupBy(by).agg(F.sum(F.col("dx") / F.col("_r")).alias("c"), F.sum(F.col("dy") / F.col("_r")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(by, (F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("length"), F.atan2("s", "c").alias("direction"))


def nearest_neighbour_ratio(points: DataFrame, by: str, width: float) -> DataFrame:
    """Mean nearest distance over that of a random pattern in the bounding box."""
    boxes = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    means = nearest(points, by, width).groupBy(by).agg(F.avg("distance").alias("observed"))
    expected = 0.5 / F.sqrt(F.col("n") / F.col("area"))
    return boxes.join(means, by).select(by, "observed", expected.alias("expected"), ratio(F.col("observed"), expected).alias("ratio"))


def random_lengths(cells: DataFrame, by: str, patterns: int = 999, seed: int = 42) -> DataFrame:
    """Length of the mean unit vector from ``cx, cy`` of random patterns of ``n`` points inside each cell's polygon ``corners``.

    A row for each cell and pattern; points are drawn where the row is, from a hash of both,
    so that no points are shuffled and a rerun draws the same.
    """

    @F.pandas_udf("double")
    def length(n: pd.Series, cx: pd.Series, cy: pd.Series, corners: pd.Series, draw: pd.Series) -> pd.Series:
        found = []
        for size, x0, y0, polygon, s in zip(n, cx, cy, corners, draw):
            p = np.array([[c["x"], c["y"]] for c in polygon], float)
            q, random, left, total = np.roll(p, -1, axis=0), np.random.default_rng(int(s) & (2**63 - 1)), int(size), np.zeros(2)
            while left:
                points = p.min(axis=0) + random.random((min(2 * left + 8, 1 << 14), 2)) * np.ptp(p, axis=0)
                x, y = points[:, 0, None], points[:, 1, None]
                # a ray to the right crosses the outline an odd number of times
                crossed = (p[:, 1] > y) != (q[:, 1] > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    at = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
                inside = points[(crossed & (x < at)).sum(axis=1) % 2 == 1][:left]
                left -= len(inside)
                off = inside - (x0, y0)
                total += (off / np.hypot(off[:, 0], off[:, 1])[:, None]).sum(axis=0)
            found.append(float(np.hypot(*total)) / size)
        return pd.Series(found, dtype="float64")

    drawn = cells.select(by, "n", "cx", "cy", "corners", F.explode(F.sequence(F.lit(1), F.lit(patterns))).alias("pattern"))
    return drawn.select(by, "pattern", length("n", "cx", "cy", "corners", F.xxhash64(by, "pattern", F.lit(seed))).alias("null_length"))


def outlined(points: DataFrame, by: str) -> DataFrame:
    """Groups with their centre, number of points and convex hull; those whose hull has no area fall out."""
    source = points.withColumn(by, F.col(by).cast("long"))
    corners = hull_corners(source, by).groupBy(by).agg(F.collect_list(F.struct("x", "y")).alias("_c"))
    middle = source.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"))
    centre = F.struct(F.aggregate("_c", F.lit(0.0), lambda t, c: t + c["x"]) / F.size("_c"), F.aggregate("_c", F.lit(0.0), lambda t, c: t + c["y"]) / F.size("_c"))
    turned = F.transform("_c", lambda c: F.struct(F.atan2(c["y"] - F.col("_m.col2"), c["x"] - F.col("_m.col1")).alias("a"), c["x"].alias("x"), c["y"].alias("y")))
    ring = F.transform(F.array_sort(turned), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    return corners.where("size(_c) > 2").withColumn("_m", centre).select(by, ring.alias("corners")).join(middle, by)


def random_polarisation(offsets: DataFrame, by: str, cells: DataFrame, patterns: int = 999, seed: int = 42) -> DataFrame:
    """Length of each group's mean direction against random patterns in its polygon.

    ``p`` is the share of patterns at least as long; ``relative`` the length beyond the
    patterns' mean: 0 for that, 1 for all one way.  ``cells`` are as ``outlined`` gives them.
    """
    nulls = random_lengths(cells, by, patterns, seed)
    own = polarisation(offsets, by)
    counts = nulls.join(own, by).groupBy(by, "length").agg(F.count(F.when(F.col("null_length") >= F.col("length"), 1)).alias("above"), F.avg("null_length").alias("expected"))
    relative = F.when(F.col("expected") < 1, (F.col("length") - F.col("expected")) / (1 - F.col("expected"))).otherwise(0.0)
    return counts.select(by, "length", (F.col("above") / patterns).alias("p"), relative.alias("relative"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise."""
    rows = sorted(set(map(tuple, points)))
    if len(rows) < 3:
        return np.array(rows, float)

    def chain(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]), float)


def hull_corners(points: DataFrame, by: str, parts: int = 64) -> DataFrame:
    """Hull corners of each group: hulls of hashed parts first, then the hull of their corners."""
    schema = f"{by} long, x double, y double"

    def corners(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = hull(rows[["x", "y"]].to_numpy(float))
        return pd.DataFrame({by: key[0], "x": found[:, 0], "y": found[:, 1]})

    source = points.where("x is not null and y is not null").select(F.col(by).cast("long").alias(by), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    split = source.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    return split.groupBy(by, "_part").applyInPandas(corners, schema).groupBy(by).applyInPandas(corners, schema)


def hull_measures(points: DataFrame, by: str) -> DataFrame:
    """Area, perimeter and largest diameter of each group's convex hull."""

    def measured(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = hull(rows[["x", "y"]].to_numpy(float))
        q = np.roll(p, -1, axis=0)
        area = abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2
        across = float(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)).max())
        return pd.DataFrame({by: [key[0]], "area": [area], "perimeter": [float(np.sqrt(((p - q) ** 2).sum(axis=1)).sum())], "diameter": [across]})

    return hull_corners(points, by).groupBy(by).applyInPandas(measured, f"{by} long, area double, perimeter double, diameter double")


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the least circle around points, from pairs and triples of hull corners."""
    corners = hull(points)
    if len(corners) == 1:
        return float(corners[0, 0]), float(corners[0, 1]), 0.0

    def of_two(p, q):
        return (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, float(np.hypot(*(p - q))) / 2

    def of_three(p, q, r):
        d = 2 * ((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        if not d:
            return None
        b, c = ((q - p) ** 2).sum(), ((r - p) ** 2).sum()
        x, y = ((r[1] - p[1]) * b - (q[1] - p[1]) * c) / d, ((q[0] - p[0]) * c - (r[0] - p[0]) * b) / d
        return x + p[0], y + p[1], float(np.hypot(x, y))

    def outside(circle, p):
        return np.hypot(p[0] - circle[0], p[1] - circle[1]) > circle[2] * (1 + 1e-12) + 1e-15

    # a point outside the circle so far is on the edge of the next
    circle = of_two(corners[0], corners[1])
    for i in range(len(corners)):
        if not outside(circle, corners[i]):
            continue
        circle = (*corners[i], 0.0)
        for j in range(i):
            if not outside(circle, corners[j]):
                continue
            circle = of_two(corners[i], corners[j])
            for k in range(j):
                if outside(circle, corners[k]):
                    circle = of_three(corners[i], corners[j], corners[k]) or circle
    return tuple(map(float, circle))


def enclosing_circles(points: DataFrame, by: str) -> DataFrame:
    """Least circle around each group's points."""

    def circled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y, r = enclosing_circle(rows[["x", "y"]].to_numpy(float))
        return pd.DataFrame({by: [key[0]], "cx": [x], "cy": [y], "radius": [r]})

    return hull_corners(points, by).groupBy(by).applyInPandas(circled, f"{by} long, cx double, cy double, radius double")


def orientation(offsets: DataFrame, by: str) -> DataFrame:
    """Angle of each group's ellipse against the line from the origin to its centre, folded to a right angle, in degrees."""
    ellipse = deviational_ellipse(offsets, by)
    centre = offsets.groupBy(by).agg(F.atan2(F.avg("y"), F.avg("x")).alias("_to"))
    turn = F.pmod(F.degrees(F.col("theta") - F.col("_to")), F.lit(180.0))
    return ellipse.join(centre, by).select(by, F.when(turn > 90, 180 - turn).otherwise(turn).alias("angle"))
