"""Lookups, folds and spatial joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.lineage import cut
from mensura.operators.schema import prefixed

HOT_ROWS = 4096
HOT_SHARE = 1 << 16
LIST = 512  # keys of one interval that are kept in one list
BLOCK = 4096  # rows of a cell that meet in one block


def last_wins(dim: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A dimension with the last row, in a stated order, of each key."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return dim.withColumn("_n", number).where("_n = 1").drop("_n")


def looked_up(df: DataFrame, dim: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with the columns of a dimension; repeated keys count once, the last."""
    return df.join(last_wins(dim, key, order), key, "left")


def outer_fold(sheets: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for each key of any sheet, with the columns of each under its name."""
    named = [prefixed(sheet, f"{name}_", (key,)) for name, sheet in sheets.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def outer_on_common(a: DataFrame, b: DataFrame, besides: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on all columns that both have, but for some."""
    return a.join(b, [c for c in a.columns if c in b.columns and c not in besides], "full")


def updated(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` with the values of ``new`` where that has the key and they are not null."""
    shared = [c for c in df.columns if c in new.columns and c != key]
    held = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in shared])
    out = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in df.columns]
    return df.join(held, key, "left").select(*out)


def joined_unskewed(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner", number: str = "n") -> DataFrame:
    """``rows`` joined (inner, left or left_anti) with ``table``, which has each key once and in ``number`` how many rows have it.

    Keys of more than ``HOT_ROWS`` rows and a ``HOT_SHARE``-th of all are so few, fewer than
    ``HOT_SHARE``, that their part of the table is broadcast and their rows stay where they
    are; all others are shuffled.  Both sides are read more than once: hand in what was cut
    or what is cheap to read.
    """
    total = table.agg(F.sum(number)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = table.where(F.col(number) > limit), table.where(F.col(number) <= limit)
    if hot.isEmpty():
        return rows.join(cold, key, how)
    hot = F.broadcast(cut(hot))  # fewer than HOT_SHARE rows
    rest = rows.join(hot.select(*key), key, "left_anti").join(cold, key, how)
    return rest if how == "left_anti" else rows.join(hot, key).unionByName(rest)


def overlapping(a: DataFrame, b: DataFrame, cell: int, on: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs of half-open intervals ``start, stop`` that overlap.

    Both sides go to every cell of fixed width that they touch, meet there by equality,
    and a pair counts in the cell where the overlap starts.
    """

    def celled(df: DataFrame, tag: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell))
        return df.where("start < stop").select(*on, F.explode(cells).alias("_cell"), F.struct(*[c for c in df.columns if c not in on]).alias(tag))

    met = celled(a, "a").join(celled(b, "b"), [*on, "_cell"])
    first = F.floor(F.greatest("a.start", "b.start") / cell)
    return met.where((F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop")) & (F.col("_cell") == first)).drop("_cell")


def overlapping_within(df: DataFrame, cell: int, on: list[str] = [], key: str = "id", block: int = BLOCK, most: int = LIST) -> DataFrame:  # noqa: B006
    """Pairs ``a < b`` of keys whose half-open intervals ``start, stop`` overlap, with the length ``shared``.

    Keys of one interval are a list, and lists meet in cells as in :func:`overlapping`, each
    pair of lists once; so only pairs that are wanted are made, one by one from two lists.
    Rows of a cell are dealt to blocks and pairs of blocks to a stated number of partitions:
    tables too small for more than one task by their bytes may have any number of pairs.  Null
    keys and empty intervals are in no pair, and a key is not paired with itself.
    """
    at = [*on, "start", "stop"]
    rows = df.where("start < stop").select(*at, F.col(key).alias("_k")).dropna()
    counts = cut(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
    chunk = F.pmod(F.xxhash64("_k"), F.floor((F.col("n") - 1) / most) + 1).alias("_chunk")
    listed = joined_unskewed(rows, counts, at).select(*at, chunk, "_k").groupBy(*at, "_chunk").agg(F.collect_list("_k").alias("_ks"))  # some ``most`` keys
    lists = cut(listed.drop("_chunk").withColumn("_list", F.monotonically_increasing_id()))
    cells = lists.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell))))
    blocks = cells.groupBy(*on, "_cell").agg((F.floor((F.sum(F.size("_ks")) - 1) / block) + 1).alias("_blocks"), F.count(F.lit(1)).alias("n"))
    dealt = cut(joined_unskewed(cells, cut(blocks), [*on, "_cell"]).withColumn("_own", F.pmod(F.xxhash64("_list"), F.col("_blocks"))).drop("n"))

    def side(tag: str) -> DataFrame:
        last, own = F.col("_blocks") - 1, F.col("_own")
        others = F.sequence(own, last) if tag == "_a" else F.sequence(F.lit(0).cast("long"), own)
        other = dealt.select(*on, "_cell", own, F.struct("start", "stop", "_list", "_ks").alias(tag), F.explode(others).alias("_other"))
        i, j = ("_own", "_other") if tag == "_a" else ("_other", "_own")
        place = other.select(*on, "_cell", F.col(i).alias("_i"), F.col(j).alias("_j"), tag)
        return place.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "_cell", "_i", "_j")

    first = F.greatest("_a.start", "_b.start")
    shared = F.least("_a.stop", "_b.stop") - first
    once = (F.col("_i") < F.col("_j")) | (F.col("_a._list") <= F.col("_b._list"))
    met = side("_a").hint("merge").join(side("_b"), [*on, "_cell", "_i", "_j"])
    met = met.where(once & (F.col("_a.start") < F.col("_b.stop")) & (F.col("_b.start") < F.col("_a.stop")) & (F.col("_cell") == F.floor(first / cell)))
    met = met.select(*on, shared.alias("shared"), (F.col("_a._list") == F.col("_b._list")).alias("_same"), F.col("_a._ks").alias("_x"), F.col("_b._ks").alias("_y"))
    pairs = met.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y")).where((F.col("_x") < F.col("_y")) | ((F.col("_x") > F.col("_y")) & ~F.col("_same")))
    return pairs.select(*on, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "shared")


def within_radius(points: DataFrame, radius: float, key: str = "id", on: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs ``a < b`` of points at most ``radius`` apart, by a grid of cells of that width."""
    grid = points.select(*on, key, "x", "y", F.floor(F.col("x") / radius).alias("_gx"), F.floor(F.col("y") / radius).alias("_gy"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("_s")
    left = grid.select(*on, F.col(key).alias("a"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), "_gx", "_gy", steps).select(
        *on, "a", "_ax", "_ay", (F.col("_gx") + F.col("_s.dx")).alias("_gx"), (F.col("_gy") + F.col("_s.dy")).alias("_gy")
    )
    right = grid.withColumnsRenamed({key: "b", "x": "_bx", "y": "_by"})
    apart = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2))
    return left.join(right, [*on, "_gx", "_gy"]).where("a < b").withColumn("distance", apart).where(F.col("distance") <= radius).select(*on, "a", "b", "distance")


def nearest(points: DataFrame, on: str, width: float, key: str = "id", targets: DataFrame | None = None) -> DataFrame:
    """Distance of each point to the nearest other of its group ``on``; groups of one fall out.

    With ``targets`` (``on, x, y``), to the nearest of those; groups without any fall out.

    Points look in the cells around them; those with no neighbour within a cell's width
    look again in cells of twice the width, so that a dense group makes no pairs of all.
    """
    sizes = points.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1") if targets is None else targets
    waiting = cut(points.where("x is not null and y is not null").join(sizes.select(on), on, "left_semi").select(on, key, "x", "y"))
    every = waiting if targets is None else cut(targets.select(on, F.lit(None).alias(key), "x", "y").distinct())
    found = []
    while not waiting.isEmpty():
        steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
        left = waiting.select(on, F.col(key).alias("a"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), steps.alias("_s")).select(
            on, "a", "_ax", "_ay", (F.floor(F.col("_ax") / width) + F.col("_s.dx")).alias("_gx"), (F.floor(F.col("_ay") / width) + F.col("_s.dy")).alias("_gy")
        )
        right = every.select(on, F.col(key).alias("b"), F.col("x").alias("_bx"), F.col("y").alias("_by"), F.floor(F.col("x") / width).alias("_gx"), F.floor(F.col("y") / width).alias("_gy"))
        apart = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2))
        near = left.join(right, [on, "_gx", "_gy"]).where("b is null or a <> b").withColumn("distance", apart).where(F.col("distance") <= width)
        found.append(cut(near.groupBy(on, "a").agg(F.min("distance").alias("distance"))))
        waiting = cut(waiting.join(found[-1].select(on, F.col("a").alias(key)), [on, key], "left_anti"))
        width *= 2
    if not found:
        return points.limit(0).select(on, F.col(key).alias("a"), F.lit(0.0).alias("distance"))
    return reduce(DataFrame.unionByName, found)


def shared_cells(a: DataFrame, b: DataFrame, at: list[str]) -> DataFrame:
    """How many places each pair of labels has in common."""
    left, right = a.withColumnRenamed("label", "a"), b.withColumnRenamed("label", "b")
    return left.join(right, at).groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
