"""Work that spreads over masks, in tiles: growth of seeds, thinning, distance to the edge.

A mask is a table of foreground places ``y, x`` of the images or objects that the columns
``on`` name.  A task holds a square tile and a margin of its neighbours, works until the tile
stands still, and tiles go on only where a margin has changed.  So rounds follow the number
of tiles that a path crosses, not its length in places.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.lineage import cut

TILE = 256
MARGIN = 16
_CROSS = [(-1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
_AROUND = _CROSS + [(-1, -1, sqrt(2)), (-1, 1, sqrt(2)), (1, -1, sqrt(2)), (1, 1, sqrt(2))]
_SAME = 1e-9
BLOCK = 1 << 20  # places of an image that are worked together
_STEPS = 128  # rows that are looked at step by step
_NONE = 1 << 60  # no background
_FAR = 1 << 30


def _tiles(margin: int, tile: int) -> Column:
    """The tiles that hold a place in them or in their margin."""
    around = [F.struct(F.floor((F.col("y") + dy) / tile).alias("ty"), F.floor((F.col("x") + dx) / tile).alias("tx")) for dy in (-margin, 0, margin) for dx in (-margin, 0, margin)]
    return F.array_distinct(F.array(*around))


def _dealt(state: DataFrame, margin: int, tile: int) -> DataFrame:
    """Rows in every tile that they concern; ``own`` in the one that they lie in, ``shared`` if there are others."""
    spread = state.withColumn("_t", _tiles(margin, tile)).withColumn("shared", F.size("_t") > 1)
    placed = spread.withColumn("_s", F.explode("_t")).withColumns({"ty": F.col("_s.ty"), "tx": F.col("_s.tx")}).drop("_t", "_s")
    return placed.withColumn("own", (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx")))


def _parted(state: DataFrame, on: list[str], tile: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of masks that lie in one tile, marked as their own, and those of the others, if there are any."""
    ty, tx = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)
    across = cut(state.groupBy(*on).agg(F.min(ty).alias("_a"), F.max(ty).alias("_b"), F.min(tx).alias("_c"), F.max(tx).alias("_d")).where("_a < _b or _c < _d").select(*on))
    marks = {"own": F.lit(True), "shared": F.lit(False)}
    if across.isEmpty():
        return state.withColumns(marks), None
    return state.join(across, on, "left_anti").withColumns(marks), state.join(across, on, "left_semi")


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def grown(mask: DataFrame, seeds: DataFrame, neighbours: int = 4, on: list[str] = ["image"], tile: int = TILE) -> DataFrame:  # noqa: B006
    """Places of the mask that seeds reach within it: ``label`` of the nearest seed and ``distance``.

    Seeds are places with a ``label``.  All grow at one pace, by one place a step, with eight
    neighbours diagonals count by their length; of seeds at one distance that of the least label
    takes the place.  Seeds outside the mask, places that none reaches, and rows with a null
    place fall out; repeated places count once.
    """
    steps = _CROSS if neighbours == 4 else _AROUND
    places = mask.select(*on, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna().distinct()
    first = seeds.groupBy(*on, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.min("label").cast("long").alias("label"))
    state = cut(places.join(first, [*on, "y", "x"], "left").withColumn("distance", F.when(F.col("label").isNotNull(), 0.0)))
    kept = [*on, "y", "x", "label", "distance"]
    schema = _fields(state, kept) + ", moved boolean"

    def relaxed(group: pa.Table) -> pa.Table:
        y, x = (np.asarray(group.column(c)) for c in ("y", "x"))
        y0, x0 = y.min() - 1, x.min() - 1
        far = np.iinfo(np.int64).max
        distance = np.full((y.max() - y0 + 2, x.max() - x0 + 2), np.inf)
        label, inside = np.full(distance.shape, far), np.zeros(distance.shape, bool)
        at = y - y0, x - x0
        inside[at] = True
        start = np.asarray(group.column("distance").combine_chunks().fill_null(np.inf)), np.asarray(group.column("label").combine_chunks().fill_null(far))
        distance[at], label[at] = start
        inner = inside[1:-1, 1:-1]
        h, w = distance.shape
        moving = True
        while moving:
            moving = False
            for dy, dx, length in steps:
                d = distance[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] + length
                m = label[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
                own, named = distance[1:-1, 1:-1], label[1:-1, 1:-1]
                with np.errstate(invalid="ignore"):
                    nearer = d < own - _SAME
                    better = inner & (nearer | ((d <= own + _SAME) & (m < named)))
                if better.any():
                    moving = True
                    label[1:-1, 1:-1] = np.where(better, m, named)
                    distance[1:-1, 1:-1] = np.where(better & nearer, d, own)
        d, m = distance[at], label[at]
        moved = (d < start[0] - _SAME) | (m != start[1])
        out = group.set_column(group.column_names.index("label"), "label", pa.array(m, mask=m == far)).set_column(
            group.column_names.index("distance"), "distance", pa.array(d, mask=np.isinf(d))
        )
        marks = pa.array(moved & np.asarray(group.column("shared")))
        return out.append_column("moved", marks).filter(group.column("own")).select([*kept, "moved"])

    alone, state = _parted(state, on, tile)
    done = alone.groupBy(*on).applyInArrow(relaxed, schema).select(*kept).where("label is not null")
    while state is not None:
        state = cut(_dealt(state, 1, tile).groupBy(*on, "ty", "tx").applyInArrow(relaxed, schema))
        again = not state.where("moved").isEmpty()
        state = state.select(*kept)
        if not again:
            return done.unionByName(state.where("label is not null"))
    return done


def _thinner(mask: np.ndarray, passes: int | None) -> np.ndarray:
    """A mask with a border of background after some pairs of passes, or until nothing changes."""
    mask, done = mask.copy(), 0
    while passes is None or done < passes:
        removed = False
        for odd in (True, False):
            core = mask[1:-1, 1:-1]
            h, w = mask.shape
            # clockwise from above
            ring = [mask[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count = np.sum(ring, axis=0, dtype=np.int8)
            turns = np.sum([~a & b for a, b in zip(ring, [*ring[1:], ring[0]])], axis=0, dtype=np.int8)
            up, right, down, left = ring[0], ring[2], ring[4], ring[6]
            corner = ~(up & right & down) & ~(right & down & left) if odd else ~(up & right & left) & ~(up & down & left)
            gone = core & (count >= 2) & (count <= 6) & (turns == 1) & corner
            if gone.any():
                removed = True
                mask[1:-1, 1:-1] = core & ~gone
        done += 1
        if not removed:
            break
    return mask


def thinned(mask: DataFrame, on: list[str] = ["image"], tile: int = TILE, margin: int = MARGIN) -> DataFrame:  # noqa: B006
    """Skeleton of each mask: places go in alternating passes, by the codes of their eight neighbours.

    A place goes if it has two to six neighbours, one turn from background to foreground
    around it, and background to the south or east, or to the north or west in every other
    pass; outside the table is background.  Repeated places count once, null ones fall out.
    """
    state = cut(mask.select(*on, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna().distinct())
    kept = [*on, "y", "x"]
    schema = _fields(state, kept) + ", removed long"

    def passed(group: pa.Table) -> pa.Table:
        y, x = (np.asarray(group.column(c)) for c in ("y", "x"))
        y0, x0 = y.min() - 1, x.min() - 1
        inside = np.zeros((y.max() - y0 + 2, x.max() - x0 + 2), bool)
        inside[y - y0, x - x0] = True
        own = np.asarray(group.column("own"))
        # a margin is right for as many passes as it is wide; without one the tile stands alone
        left = _thinner(inside, None if own.all() else margin // 2)[y - y0, x - x0]
        removed = int((own & ~left).sum())
        out = group.filter(pa.array(own & left)).select(kept)
        if not out.num_rows and removed:  # the others are to go on all the same
            out = group.slice(0, 1).select(kept).set_column(len(on), "y", pa.nulls(1, pa.int64()))
        return out.append_column("removed", pa.array(np.full(out.num_rows, 0 if own.all() else removed)))

    alone, state = _parted(state, on, tile)
    done = alone.groupBy(*on).applyInArrow(passed, schema).where("y is not null").select(*kept)
    while state is not None:
        state = cut(_dealt(state, margin, tile).groupBy(*on, "ty", "tx").applyInArrow(passed, schema))
        again = not state.where("removed > 0").isEmpty()
        state = state.where("y is not null").select(*kept)
        if not again:
            return done.unionByName(state)
    return done


def line_ends(skeleton: DataFrame, on: list[str] = ["image"]) -> DataFrame:  # noqa: B006
    """Places of a skeleton with one neighbour."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx, _ in _AROUND]))
    near = skeleton.select(*on, "y", "x", offsets.alias("_s")).select(*on, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    return skeleton.join(near, [*on, "y", "x"]).groupBy(*on, "y", "x").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*on, "y", "x")


def tortuosity(labels: DataFrame, on: list[str] = ["image", "label"], tile: int = TILE) -> DataFrame:  # noqa: B006
    """Of each object's skeleton the way between its ends over the distance between them.

    With more than two ends those farthest apart count, of equal ones the first by rows.
    Returns the objects with ``ends``, ``arc``, ``chord`` and ``tortuosity``; an object with
    fewer than two ends has null ways and a tortuosity of 1.
    """
    names, on = on, [f"_key{i}" for i in range(len(on))]
    labels = labels.select(*[F.col(c).alias(k) for c, k in zip(names, on)], "y", "x")
    skeleton = cut(thinned(labels, on, tile))
    ends = cut(line_ends(skeleton, on))
    pairs = ends.alias("a").join(ends.select(*on, F.col("y").alias("y1"), F.col("x").alias("x1")), on).where("(y, x) < (y1, x1)")
    square = F.pow(F.col("y") - F.col("y1"), 2) + F.pow(F.col("x") - F.col("x1"), 2)
    best = F.max_by(F.struct("y", "x", "y1", "x1"), F.struct(square, -F.col("y"), -F.col("x"), -F.col("y1"), -F.col("x1"))).alias("p")
    chosen = cut(pairs.groupBy(*on).agg(best, F.sqrt(F.max(square)).alias("chord")).select(*on, "p.*", "chord"))
    ways = grown(skeleton, chosen.select(*on, "y", "x", F.lit(0).alias("label")), 8, on, tile)
    arcs = ways.select(*on, F.col("y").alias("y1"), F.col("x").alias("x1"), F.col("distance").alias("arc")).join(chosen, [*on, "y1", "x1"]).select(*on, "arc", "chord")
    counts = ends.groupBy(*on).agg(F.count(F.lit(1)).alias("ends"))
    every = labels.select(*on).distinct().join(counts, on, "left").join(arcs, on, "left")
    return every.select(*[F.col(k).alias(c) for c, k in zip(names, on)], F.coalesce("ends", F.lit(0)).alias("ends"), "arc", "chord", F.coalesce(F.col("arc") / F.col("chord"), F.lit(1.0)).alias("tortuosity"))


def _envelope(y: np.ndarray, x: int, across: np.ndarray, near: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance and place of the nearest background for the foreground ``y``, in order, of one column.

    The lower envelope of the parabolas over the distances along the rows is taken, within
    runs of foreground and the background that ends them.
    """
    square, edge_y, edge_x = np.full(len(y), _NONE), np.full(len(y), -1), np.full(len(y), -1)
    opens = np.flatnonzero(np.concatenate(([True], np.diff(y) > 1))).tolist()
    for a, b in zip(opens, [*opens[1:], len(y)]):
        sites = [(int(y[a]) - 1, 0, x)] if y[a] > 0 else []
        sites += [(int(y[k]), int(across[k]), int(near[k])) for k in range(a, b) if across[k] < _NONE]
        sites += [(int(y[b - 1]) + 1, 0, x)] if y[b - 1] < height - 1 else []
        hold: list[tuple[float, int, int, int]] = []
        for sy, sq, sx in sites:
            start = -np.inf
            while hold:
                _, py, pq, _ = hold[-1]
                start = ((sq + sy * sy) - (pq + py * py)) / (2.0 * (sy - py))
                if start > hold[-1][0]:
                    break
                hold.pop()
                start = -np.inf
            hold.append((start, sy, sq, sx))
        if hold:
            # at a start both are equally near, and the one before has the lesser row
            place = np.searchsorted([h[0] for h in hold], y[a:b], "left") - 1
            sy, sq, sx = (np.array([h[c] for h in hold])[place] for c in (1, 2, 3))
            square[a:b], edge_y[a:b], edge_x[a:b] = (y[a:b] - sy) ** 2 + sq, sy, sx
    return square, edge_y, edge_x


def distance_transform(mask: DataFrame, width: int, height: int, on: list[str] = ["image"], most: int = BLOCK) -> DataFrame:  # noqa: B006
    """Euclidean distance of each foreground place to the nearest background of its image, and that place.

    Along the rows every run of foreground knows the background at its ends.  Columns are
    worked together in blocks of at most ``most`` places: the rows above and below are looked
    at step by step, and columns of a depth over ``_STEPS`` each by its lower envelope.
    Outside the image is not background.  Returns ``square``, the squared distance, and
    ``edge_y``, ``edge_x``, of equally near places the first by rows; null for an image
    without background.
    """
    columns = max(1, most // max(height, 1))
    whole = columns >= width
    block = F.lit(0) if whole else F.floor(F.col("x") / columns)
    places = mask.select(*on, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
    if whole:
        rows = places.withColumn("_b", block).repartition(*on, "_b").distinct()
    else:
        order = Window.partitionBy(*on, "y").orderBy("x")
        run = Window.partitionBy(*on, "y", "_g")
        left, right = F.min("x").over(run) - 1, F.max("x").over(run) + 1
        rows = places.distinct().withColumn("_g", F.col("x") - F.row_number().over(order))
        rows = rows.select(*on, "y", "x", F.when(left >= 0, left).alias("left"), F.when(right < width, right).alias("right"), block.alias("_b"))

    def by_columns(group: pa.Table) -> pa.Table:
        y, x = (np.asarray(group.column(c)) for c in ("y", "x"))
        y0, x0 = y.min() - 1, x.min() - 1
        at = y - y0, x - x0
        inside = np.zeros((y.max() - y0 + 2, x.max() - x0 + 2), bool)
        inside[at] = True
        row, column = np.arange(len(inside))[:, None] + y0, np.arange(inside.shape[1])[None, :] + x0
        if whole:
            back = ~inside & (column >= 0) & (column < width)
            left = np.maximum.accumulate(np.where(back, column, -_NONE), axis=1)
            right = np.minimum.accumulate(np.where(back, column, _NONE)[:, ::-1], axis=1)[:, ::-1]
        else:
            left, right = np.full(inside.shape, -_NONE), np.full(inside.shape, _NONE)
            left[at] = np.asarray(group.column("left").combine_chunks().fill_null(-_NONE))
            right[at] = np.asarray(group.column("right").combine_chunks().fill_null(_NONE))
        # numbers are far below the root of the greatest one but where there is no background
        to_left, to_right = (np.minimum(d, _FAR) for d in (column - left, right - column))
        near = np.where(to_left <= to_right, left, right)
        across = np.where(np.minimum(to_left, to_right) < _FAR, np.minimum(to_left, to_right) ** 2, _NONE)
        ends = ~inside & (row >= 0) & (row < height)
        across = np.where(inside, across, np.where(ends, 0, _NONE))
        near = np.where(inside, near, column)
        square, edge_y, edge_x = across.copy(), np.broadcast_to(row, across.shape).copy(), near.copy()
        step, deep = 1, np.where(inside, square, 0).max(axis=0)
        while step < len(square) and step <= _STEPS and (deep >= step * step).any():
            for to, of, better in ((np.s_[step:], np.s_[:-step], np.less_equal), (np.s_[:-step], np.s_[step:], np.less)):
                # of equally near ones above, the farther row is the lesser
                found = across[of] + step * step
                closer = better(found, square[to]) & (across[of] < _NONE)
                square[to] = np.where(closer, found, square[to])
                edge_y[to] = np.where(closer, np.broadcast_to(row, across.shape)[of], edge_y[to])
                edge_x[to] = np.where(closer, near[of], edge_x[to])
            step, deep = step + 1, np.where(inside, square, 0).max(axis=0)
        if step < len(square):
            for k in np.flatnonzero(deep >= step * step):
                own = np.flatnonzero(inside[:, k])
                square[own, k], edge_y[own, k], edge_x[own, k] = _envelope(own + y0, int(k + x0), across[own, k], near[own, k], height)
        none = square[at] >= _NONE
        out = group.select([*on, "y", "x"])
        return out.append_column("square", pa.array(square[at], mask=none)).append_column("edge_y", pa.array(edge_y[at], mask=none)).append_column("edge_x", pa.array(edge_x[at], mask=none))

    return rows.groupBy(*on, "_b").applyInArrow(by_columns, _fields(places, [*on, "y", "x"]) + ", square long, edge_y long, edge_x long")


def deepest(mask: DataFrame, width: int, height: int, on: list[str] = ["image"]) -> DataFrame:  # noqa: B006
    """The place of each image farthest from its background, of equal ones the first by rows, and its distance.

    An image without background has no such place and no row.
    """
    found = distance_transform(mask, width, height, on).where("square is not null").groupBy(*on).agg(F.max(F.struct("square", -F.col("y"), -F.col("x"))).alias("m"))
    return found.select(*on, F.sqrt("m.square").alias("depth"), (-F.col("m.col2")).alias("y"), (-F.col("m.col3")).alias("x"))
