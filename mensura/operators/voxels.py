"""Masks and label images as tables of their foreground places ``image, y, x``."""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.columns import ratio
from mensura.functions.lineage import cut
from mensura.operators.aggregate import histogram
from mensura.operators.components import least_member
from mensura.operators.tiles import TILE, grown

PLACE = ["image", "y", "x"]


def _steps(shape: str, radius: int = 1) -> list[tuple[int, int]]:
    """Offsets of a square, cross or disc about the middle."""
    near = {
        "square": lambda dy, dx: True,
        "cross": lambda dy, dx: abs(dy) + abs(dx) <= radius,
        "disc": lambda dy, dx: dy * dy + dx * dx <= radius * radius,
    }[shape]
    around = range(-radius, radius + 1)
    return [(dy, dx) for dy in around for dx in around if near(dy, dx)]


def _moved(mask: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    spread = mask.withColumn("_s", offsets)
    return spread.withColumns({"y": F.col("y") + F.col("_s.dy"), "x": F.col("x") + F.col("_s.dx")}).drop("_s")


def thresholded(pixels: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Foreground at each threshold."""
    return pixels.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(value) >= F.col("threshold")).select("threshold", *PLACE)


def dilated(mask: DataFrame, width: int, height: int, shape: str = "square", radius: int = 1) -> DataFrame:
    """Places within reach of the mask, inside the image."""
    return _moved(mask.select(*PLACE), _steps(shape, radius)).where(f"x between 0 and {width - 1} and y between 0 and {height - 1}").distinct()


def eroded(mask: DataFrame, shape: str = "square", radius: int = 1) -> DataFrame:
    """Places all of whose neighbourhood is in the mask; outside the image is background."""
    steps = _steps(shape, radius)
    return _moved(mask.select(*PLACE), steps).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n")).where(f"_n = {len(steps)}").join(mask.select(*PLACE), PLACE, "left_semi").select(*PLACE)


def opened(mask: DataFrame, width: int, height: int, shape: str = "square") -> DataFrame:
    return dilated(eroded(mask, shape), width, height, shape)


def closed(mask: DataFrame, width: int, height: int, shape: str = "square") -> DataFrame:
    """Dilation beyond the image, then erosion, within it."""
    wide = _moved(mask.select(*PLACE), _steps(shape)).distinct()
    return eroded(wide, shape).where(f"x between 0 and {width - 1} and y between 0 and {height - 1}")


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersection, difference or exclusive union of two masks."""
    left, right = a.select(*PLACE), b.select(*PLACE)
    if how == "or":
        return left.unionByName(right).distinct()
    if how == "and":
        return left.distinct().join(right, PLACE, "left_semi")
    if how == "subtract":
        return left.distinct().join(right, PLACE, "left_anti")
    return left.distinct().unionByName(right.distinct()).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*PLACE)


def labelled(mask: DataFrame, width: int, neighbours: int = 8, tile: int = TILE) -> DataFrame:
    """Foreground with the label of its component: the least place of it, counted by rows.

    A task labels a tile; only components that touch across the sides of tiles are nodes of a
    graph, so that images of one tile take one shuffle and no rounds.  Repeated places count
    once, rows with a null place fall out, null images are one image.
    """
    side = {"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)}
    keys = ["image", *side]
    own = mask.select(*PLACE).dropna(subset=["y", "x"]).withColumns(side).repartition(*keys).distinct()
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in PLACE)
    number = own.select((F.col("y") * width + F.col("x")).alias("n")).schema["n"].dataType
    steps = [(0, 1), (1, 0), (1, -1), (1, 1)][: 4 if neighbours == 8 else 2]

    def in_tile(group: pa.Table) -> pa.Table:
        y, x = (np.asarray(group.column(c)).astype(np.int64) for c in ("y", "x"))
        down, right = y - y.min() + 1, x - x.min() + 1
        held = np.full((down.max() + 2, right.max() + 2), -1)
        held[down, right] = np.arange(len(y))
        least = np.arange(len(y))
        for dy, dx in steps:
            other = held[down + dy, right + dx]
            least = _joined(least, np.flatnonzero(other >= 0), other[other >= 0])
        first = np.full(len(y), np.iinfo(np.int64).max)
        np.minimum.at(first, least, y * width + x)
        rim = (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1)
        return group.select(PLACE).append_column("label", pa.array(first[least])).append_column("rim", pa.array(rim))

    parts = cut(own.groupBy(*keys).applyInArrow(in_tile, f"{kinds}, label long, rim boolean"))
    named = parts.select(*PLACE, F.col("label").cast(number).alias("label"))
    rim = parts.where("rim").select(*PLACE, "label")
    ahead = _moved(rim.withColumns(side), steps).withColumnRenamed("label", "to").where(f"ty <> floor(y / {tile}) or tx <> floor(x / {tile})").drop(*side)
    same = F.col("p.image").eqNullSafe(F.col("q.image")) & (F.col("p.y") == F.col("q.y")) & (F.col("p.x") == F.col("q.x"))
    ends = [F.struct(F.col(f"{t}.image").alias("image"), F.col(c).alias("label")).alias(e) for e, t, c in (("a", "p", "p.to"), ("b", "q", "q.label"))]
    links = cut(ahead.alias("p").join(rim.alias("q"), same).select(*ends).distinct())
    if links.isEmpty():
        return named
    nodes = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    roots = cut(least_member(nodes, links, "a").select("a.image", F.col("a.label").alias("label"), F.col("root.label").alias("root")))
    same = F.col("n.image").eqNullSafe(F.col("r.image")) & (F.col("n.label") == F.col("r.label"))
    return named.alias("n").join(roots.alias("r"), same, "left").select("n.image", "n.y", "n.x", F.coalesce("r.root", "n.label").cast(number).alias("label"))


def _joined(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component after links between ``a`` and ``b``."""
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != least[least]).any():
            least = least[least]


def region_props(labels: DataFrame) -> DataFrame:
    """Area, bounding box, centroid and central second moments of every label."""
    return labels.groupBy("image", "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("vyx"),
    )


def sized(labels: DataFrame, least: int, most: int) -> DataFrame:
    """Places of labels of an area from ``least`` to below ``most``."""
    kept = labels.groupBy("image", "label").agg(F.count(F.lit(1)).alias("_n")).where(f"_n >= {least} and _n < {most}").select("image", "label")
    return labels.join(kept, ["image", "label"], "left_semi")


def holes(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Labelled background, four neighbours counting, that doesn't reach the image's edge."""
    rows = mask.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    every = rows.select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    back = labelled(every.join(mask.select(*PLACE), PLACE, "left_anti"), width, 4)
    outside = back.where(f"x = 0 or y = 0 or x = {width - 1} or y = {height - 1}").select("image", "label").distinct()
    return back.join(outside, ["image", "label"], "left_anti")


def filled(mask: DataFrame, width: int, height: int) -> DataFrame:
    return combined(mask, holes(mask, width, height), "or")


def overlap_fraction(labels: DataFrame, mask: DataFrame, fraction: float) -> DataFrame:
    """Area of every label, its area in a mask, and whether that is over the fraction."""
    inside = mask.select(*PLACE).distinct().withColumn("_in", F.lit(1))
    counts = labels.join(inside, PLACE, "left").groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"), F.count("_in").alias("overlap"))
    return counts.withColumn("positive", F.col("overlap") > fraction * F.col("area"))


def low_intensity(labels: DataFrame, pixels: DataFrame, value: str, share: float) -> DataFrame:
    """Labels whose least intensity is below a share of their image's mean."""
    means = pixels.groupBy("image").agg(F.avg(value).alias("mean"))
    least = labels.join(pixels, PLACE).groupBy("image", "label").agg(F.min(value).alias("least"))
    return least.join(means, "image").where(F.col("least") < share * F.col("mean")).select("image", "label", "least")


def zone_counts(labels: DataFrame, zone: DataFrame, width: int, height: int, radius: int = 1) -> DataFrame:
    """Labels of each image that reach into the zone widened by the radius, all labels, and the share."""
    wide = dilated(zone, width, height, "square", radius).withColumn("_z", F.lit(1))
    marked = labels.join(wide, PLACE, "left").groupBy("image", "label").agg(F.max("_z").alias("_z"))
    return marked.groupBy("image").agg(F.count("_z").alias("in_zone"), F.count(F.lit(1)).alias("labels")).withColumn("share", ratio(F.col("in_zone"), F.col("labels")))


def neighbour_steps(labels: DataFrame, radius: int) -> DataFrame:
    """Cross-shaped dilations until each label touches another, and labels within the radius.

    Labels with none within the radius have no steps.
    """
    offsets = [(dy, dx) for dy, dx in _steps("cross", radius) if (dy, dx) != (0, 0)]
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(abs(dy) + abs(dx)).alias("d")) for dy, dx in offsets]))
    spread = labels.select("image", "label", "y", "x", near.alias("_s")).select(
        "image", "label", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("_s.d").alias("d")
    )
    met = spread.join(labels.withColumnRenamed("label", "other"), PLACE).where("label <> other")
    found = met.groupBy("image", "label", "other").agg(F.min("d").alias("d")).groupBy("image", "label").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("neighbours"))
    every = labels.select("image", "label").distinct().join(found, ["image", "label"], "left")
    return every.select("image", "label", F.greatest(F.col("d") - 1, F.lit(0)).alias("steps"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def otsu(pixels: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """The bin of a histogram after which the variance between the classes is largest."""
    order = Window.orderBy("bin")
    counts = histogram(pixels, value, low, high, bins)
    sums = counts.select("bin", F.sum("n").over(order).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(order).alias("s0"))
    whole = counts.agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("bin")).alias("s"))
    rest = F.col("w") - F.col("w0")
    apart = ratio(F.col("s0").cast("double"), F.col("w0")) - ratio((F.col("s") - F.col("s0")).cast("double"), rest)
    scored = sums.join(F.broadcast(whole)).where("w0 < w").withColumn("between", F.round(F.col("w0") * rest * apart * apart / F.col("w") / F.col("w"), 9))
    return scored.agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"), F.max("between").alias("between"))


def projected(stack: DataFrame, value: str, how: str) -> DataFrame:
    """Projection along z: deviation, quartile range, variation or median deviation at each place."""
    # a place has no more values than the stack has slices
    if how == "mad":
        middles = stack.groupBy(*PLACE).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
        return stack.join(middles, PLACE).groupBy(*PLACE).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("value"))
    found = {
        "std": F.stddev_pop(value),
        "iqr": F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25)),
        "cv": ratio(F.stddev_pop(value), F.avg(value)),
    }[how]
    return stack.groupBy(*PLACE).agg(found.alias("value"))


def cropped(mask: DataFrame, padding: int = 0) -> DataFrame:
    """Each image moved to the corner of its bounding box, less a padding."""
    boxes = mask.groupBy("image").agg(F.min("y").alias("_y"), F.min("x").alias("_x"))
    return mask.join(boxes, "image").select("image", (F.col("y") - F.col("_y") + padding).alias("y"), (F.col("x") - F.col("_x") + padding).alias("x"))


def separated(mask: DataFrame, width: int, height: int, least: int, most: int) -> DataFrame:
    """Touching objects apart: places of the mask with the ``seed`` that they belong to and the ``label`` of what they make up.

    Components of the mask less a ring of one place are seeds and grow back within the mask,
    all at one pace and to four neighbours, of equally near ones the one of least label.
    Only what seeds of an area over ``least`` and below ``most`` have taken stays.
    """
    seeds = cut(labelled(eroded(mask), width))
    areas = seeds.groupBy("image", "label").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {least} and _n < {most}").select("image", F.col("label").alias("seed"))
    taken = cut(grown(mask, seeds).select(*PLACE, F.col("label").alias("seed")).join(areas, ["image", "seed"], "left_semi"))
    return labelled(taken, width).join(taken, PLACE).select(*PLACE, "seed", "label")


def adaptive(pixels: DataFrame, value: str, block: int, less: float, method: str = "mean") -> DataFrame:
    """Foreground of full images: places brighter than the mean of a square window about them, less a constant.

    The window is ``block`` places wide, an odd number; beyond the edge the edge's values go
    on.  Means are rounded to whole numbers, halves to the even one.  The plain mean takes two
    running sums, one along each axis, whatever the window; ``gaussian`` weighs the window's
    places.  Rows are packed to runs where they lie, and a task holds a tile and a margin as
    wide as the window reaches.  Images with missing places are not asked for; null values count as zero.
    """
    if block % 2 == 0 or block <= 1:
        raise ValueError("block must be odd and more than one")
    reach = block // 2
    tile = max(TILE, reach)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    weights = [exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    kinds = {c: pixels.schema[c].dataType.simpleString() for c in PLACE}
    whole = pixels.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    held = pixels.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col(value), F.lit(0)).cast("long" if whole else "double").alias("v"))

    def runs(batches):
        for batch in batches:
            y, x = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            if not len(y):
                continue
            image = np.asarray(batch.column(0).dictionary_encode().indices)
            new = (np.diff(image) != 0) | (np.diff(y) != 0) | (np.diff(x) != 1) | (x[1:] % tile == 0)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            values = pa.ListArray.from_arrays(pa.array(np.append(starts, len(y)), pa.int32()), batch.column(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(starts)) for c in range(3)), values], ["image", "y", "x", "v"])

    def summed(wide: np.ndarray) -> np.ndarray:
        if method == "gaussian":
            n = wide.shape[1] - 2 * reach
            terms = (wide[:, k : k + n] * (w / sum(weights)) for k, w in enumerate(weights))
            return sum(terms, next(terms))
        upto = np.concatenate([np.zeros((len(wide), 1), wide.dtype), np.cumsum(wide, axis=1)], axis=1)
        return upto[:, block:] - upto[:, :-block]

    def foreground(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = group.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        y = np.repeat(np.asarray(group.column("y")), sizes)
        x = np.repeat(np.asarray(group.column("x")) - np.cumsum(sizes) + sizes, sizes) + np.arange(len(y))
        y0, x0 = y.min(), x.min()
        values = np.asarray(lists.flatten())
        full = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), values.dtype)
        full[y - y0, x - x0] = values
        # what lies beyond the rows at hand is beyond the image
        tops = [k.as_py() * tile for k in key[1:]]
        spans = [(max(t, lo), min(t + tile, lo + n)) for t, lo, n in zip(tops, (y0, x0), full.shape)]
        if spans[0][0] >= spans[0][1] or spans[1][0] >= spans[1][1]:  # in the margin of a tile of the image's edge
            at = np.empty((2, 0), np.int64)
        else:
            ys, xs = (np.clip(np.arange(lo - reach, hi + reach) - start, 0, n - 1) for (lo, hi), start, n in zip(spans, (y0, x0), full.shape))
            wide = full[np.ix_(ys, xs)]
            sums = summed(summed(wide).T).T
            mean = np.rint(sums if method == "gaussian" else sums / (block * block))
            at = np.nonzero(wide[reach : len(ys) - reach, reach : len(xs) - reach] > mean - ceil(less))
            at = at[0] + spans[0][0], at[1] + spans[1][0]
        image = pa.repeat(key[0], len(at[0]))
        return pa.table([image, *(pa.array(a, pa.int64()) for a in at)], names=PLACE)

    def near(axis: str):
        return F.explode(F.sequence(F.floor((F.col(axis) - reach) / tile), F.floor((F.col(axis) + (F.size("v") - 1 if axis == "x" else 0) + reach) / tile)))

    element = "bigint" if whole else "double"
    packed = held.mapInArrow(runs, f"image {kinds['image']}, y long, x long, v array<{element}>")
    dealt = packed.withColumn("ty", near("y")).withColumn("tx", near("x"))
    found = dealt.groupBy("image", "ty", "tx").applyInArrow(foreground, f"image {kinds['image']}, y long, x long")
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in PLACE])


def debris(pixels: DataFrame, value: str, width: int, height: int, score: float = 3.0, least: int = 50, most: int = 200_000, reach: int = 10) -> DataFrame:
    """Places of debris: components of outlying intensity, of an area from ``least`` to ``most``, and a disc about them.

    Components at the image's edge of more than four times the reach are objects cut off, and
    stay.  An image of one value has no debris.
    """
    own = Window.partitionBy("image")
    apart = F.abs(F.col(value) - F.avg(value).over(own)) / (F.stddev_pop(value).over(own) + 1e-8)
    regions = cut(labelled(pixels.withColumn("_z", apart).where(F.col("_z") > score), width))
    at_edge = F.max(((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)).cast("int"))
    kept = regions.groupBy("image", "label").agg(F.count(F.lit(1)).alias("_n"), at_edge.alias("_e"))
    kept = kept.where((F.col("_n") >= least) & (F.col("_n") <= most) & ~((F.col("_e") == 1) & (F.col("_n") > 4 * reach)))
    return dilated(regions.join(kept, ["image", "label"], "left_semi"), width, height, "disc", reach)
