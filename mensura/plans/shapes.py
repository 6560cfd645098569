"""Queries of the shapes of objects in masks: distances, separation, skeletons, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import networks, regions, splitting, tiles, voxels
from mensura.plans import fixtures as X
from mensura.plans.fixtures import rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


_AROUND = "(SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx)"


def _components(source: str, name: str) -> str:
    """SQL of the eight-connected components of a table of places, labelled by their least place."""
    return f"""{name}_n AS (SELECT image * 4096 + y * 64 + x AS id, image, y, x FROM {source}),
    {name}_m AS (SELECT id AS a, image, y + dy AS y, x + dx AS x FROM {name}_n, {_AROUND}), {name}_e AS (SELECT a, id AS b FROM {name}_m JOIN {name}_n USING (image, y, x)),
    {name}_w(id, root) AS (SELECT id, id FROM {name}_n UNION SELECT e.b, w.root FROM {name}_w w JOIN {name}_e e ON e.a = w.id WHERE w.root < e.b),
    {name} AS (SELECT image, y, x, min(root) % 4096 AS label FROM {name}_w JOIN {name}_n USING (id) GROUP BY ALL)"""


@query(
    f"""WITH {X.BLOBS}, grid AS (SELECT image, y, x FROM (SELECT DISTINCT image FROM blobs), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x)), back AS (SELECT image, y, x FROM grid EXCEPT SELECT image, y, x FROM blobs)
    SELECT f.image, f.y, f.x, CAST(min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x)) AS BIGINT) AS square FROM blobs f JOIN back b ON f.image = b.image GROUP BY 1, 2, 3"""
)
def distance_to_edge(spark, d):
    """Squared distance of every place of an object to the background."""
    return tiles.distance_transform(X.blobs(spark, d), 64, 64).select("image", "y", "x", "square")


@query(
    f"""WITH RECURSIVE {X.BLOBS}, near AS (SELECT image, y + dy AS y, x + dx AS x FROM blobs, {_AROUND}), core AS (SELECT image, y, x FROM near JOIN blobs USING (image, y, x) GROUP BY ALL HAVING count(*) = 8), {_components('core', 'seeds')}
    SELECT image, label, count(*) AS area, count(*) > 8 AND count(*) < 40 AS kept FROM seeds GROUP BY 1, 2"""
)
def separation_seeds(spark, d):
    """Cores of touching objects and whether they are of a size to grow back."""
    areas = voxels.labelled(voxels.eroded(X.blobs(spark, d)), 64).groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"))
    return areas.withColumn("kept", F.expr("area > 8 and area < 40"))


@query()
def separated_objects(spark, d):
    """Touching objects grown apart from their cores; against a plain flood in the tests."""
    return voxels.separated(X.blobs(spark, d), 64, 64, 8, 40)


@query()
def object_skeletons(spark, d):
    """Places of the skeleton of each object; against plain thinning in the tests."""
    return tiles.thinned(voxels.labelled(X.blobs(spark, d), 64), ["image", "label"])


@query()
def object_tortuosity(spark, d):
    """Way along each object's skeleton over the distance of its ends."""
    return rounded(tiles.tortuosity(voxels.labelled(X.blobs(spark, d), 64)))


def _window_mean(reach: int) -> str:
    side = f"(SELECT unnest(range({-reach}, {reach + 1})) AS d)"
    return f"""wide AS (SELECT image, y, x AS x0, greatest(0, least(63, x + d)) AS x FROM pixels, {side}), across AS (SELECT image, y, x0 AS x, sum(value) AS s FROM wide JOIN pixels USING (image, y, x) GROUP BY 1, 2, 3),
    tall AS (SELECT image, x, y AS y0, greatest(0, least(63, y + d)) AS y FROM across, {side}), sums AS (SELECT image, y0 AS y, x, sum(s) AS s FROM tall JOIN across USING (image, y, x) GROUP BY 1, 2, 3)"""


@query(f"""WITH {X.PIXELS}, {_window_mean(5)} SELECT image, y, x FROM pixels JOIN sums USING (image, y, x) WHERE value > round_even(s / 121.0, 0) - 2""")
def adaptive_threshold(spark, d):
    """Places brighter than the mean of the eleven by eleven places about them."""
    return voxels.adaptive(X.pixels(spark, d), "value", 11, 2)


@query(
    f"""WITH RECURSIVE {X.PIXELS}, stats AS (SELECT image, avg(value) AS m, stddev_pop(value) AS s FROM pixels GROUP BY image), far AS (SELECT image, y, x FROM pixels JOIN stats USING (image) WHERE abs(value - m) / (s + 1e-8) > 2), {_components('far', 'regions')},
    kept AS (SELECT image, label FROM regions GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 40 AND NOT (max(CAST(y IN (0, 63) OR x IN (0, 63) AS INTEGER)) = 1 AND count(*) > 8)),
    disc AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4)
    SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM regions JOIN kept USING (image, label), disc WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63"""
)
def debris_mask(spark, d):
    """Outlying spots of intensity and a disc about them."""
    return voxels.debris(X.pixels(spark, d), "value", 64, 64, score=2.0, least=2, most=40, reach=2)


_DOTS = "dots AS (SELECT DISTINCT l_orderkey // 512 AS image, (l_orderkey * 31 + l_linenumber * 17) % 64 AS y, l_partkey * 7 % 64 AS x FROM lineitem)"


@query(
    f"""WITH RECURSIVE {_DOTS}, moved AS (SELECT image, y AS y0, x AS x0, y + dy AS y, x + dx AS x, sqrt(abs(dy) + abs(dx)) AS step FROM dots, {_AROUND}), pairs AS (SELECT * FROM moved JOIN dots USING (image, y, x)),
    degrees AS (SELECT image, y, x, count(*) AS degree FROM pairs GROUP BY 1, 2, 3), thin AS (SELECT image, y, x FROM degrees WHERE degree < 3), whole AS (SELECT image, y, x FROM degrees), {_components('thin', 'parts')}, {_components('whole', 'nets')},
    steps AS (SELECT p.image, a.label AS branch, p.y0, p.x0, p.y, p.x, p.step, b.label AS o FROM pairs p JOIN parts a ON a.image = p.image AND a.y = p.y0 AND a.x = p.x0 LEFT JOIN parts b ON b.image = p.image AND b.y = p.y AND b.x = p.x),
    sums AS (SELECT image, branch, sum(CASE WHEN o IS NULL THEN step ELSE step / 2 END) AS length, count(*) FILTER (WHERE o IS NULL) AS joints, count(o) AS inn FROM steps GROUP BY 1, 2),
    tips AS (SELECT image, label AS branch, y, x FROM parts JOIN degrees USING (image, y, x) WHERE degree = 1 UNION ALL SELECT image, branch, y, x FROM steps WHERE o IS NULL),
    spans AS (SELECT image, branch, sqrt(pow(max(y * 64 + x) // 64 - min(y * 64 + x) // 64, 2) + pow(max(y * 64 + x) % 64 - min(y * 64 + x) % 64, 2)) AS span FROM tips GROUP BY 1, 2),
    places AS (SELECT image, parts.label AS branch, min(nets.label) AS network, count(*) AS places FROM parts JOIN nets USING (image, y, x) GROUP BY 1, 2)
    SELECT image, branch, network, CAST(CASE WHEN joints = 0 AND inn = 2 * places THEN 3 ELSE joints END AS INTEGER) AS kind, places, round(length, 6) AS length, round(coalesce(span, 0), 6) AS span
    FROM places JOIN sums USING (image, branch) LEFT JOIN spans USING (image, branch)"""
)
def skeleton_branches(spark, d):
    """Branches between the ends and junctions of thin lines."""
    return rounded(networks.branches(X.pixels(spark, d).where("value > 0"), 64))


@query()
def network_summary(spark, d):
    """Networks of the skeletons of touching objects."""
    mask = X.blobs(spark, d)
    return rounded(networks.network_summary(tiles.thinned(mask), mask, 64, 64))


@query(
    f"""WITH RECURSIVE {X.PIXELS}, over AS (SELECT t AS level, image * 3 + t AS image, y, x FROM pixels, (SELECT unnest([0, 1, 2]) AS t, unnest([20, 40, 60]) AS least) WHERE value >= least), {_components('over', 'held')}
    SELECT [20.0, 40.0, 60.0][h.image % 3 + 1]::DOUBLE AS threshold, h.image // 3 AS image, h.label, count(*) AS area, min(b.label) AS parent
    FROM held h LEFT JOIN held b ON b.image = h.image - 1 AND h.image % 3 > 0 AND b.y = h.y AND b.x = h.x GROUP BY h.image, h.label"""
)
def threshold_components(spark, d):
    """Components at three thresholds, each in its component of the one below."""
    return networks.component_tree(X.pixels(spark, d), "value", [20, 40, 60], 64)


@query()
def recovered_regions(spark, d):
    """Largest regions at falling thresholds, each without what higher ones took."""
    return networks.recovered(X.pixels(spark, d), "value", [60, 40], X.blobs(spark, d), 64, 64, largest=1, reach=2)


@query(
    f"""WITH RECURSIVE {_DOTS}, {_components('dots', 'parts')}, sizes AS (SELECT image, label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM parts GROUP BY 1, 2), small AS (SELECT * FROM sizes WHERE area > 1 AND area < 30),
    disc AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy * dy + dx * dx <= 9),
    about AS (SELECT p.image, p.label AS a, p.y + dy AS y, p.x + dx AS x FROM parts p JOIN small USING (image, label), disc WHERE p.y + dy BETWEEN y0 AND y1 AND p.x + dx BETWEEN x0 AND x1),
    touching AS (SELECT DISTINCT image, a, label AS b FROM about JOIN parts USING (image, y, x) WHERE label <> a),
    known AS (SELECT t.image, a, b, m.label IS NOT NULL AS little, count(*) OVER w AS n, count(m.label) OVER w AS n_small FROM touching t LEFT JOIN small m ON m.image = t.image AND m.label = b WINDOW w AS (PARTITION BY t.image, a)),
    links AS (SELECT image, a, b FROM known WHERE n = 1 OR (n_small > 1 AND little)), both_ways AS (SELECT image, a, b FROM links UNION SELECT image, b, a FROM links),
    reached(image, id, root) AS (SELECT image, label, label FROM sizes UNION SELECT r.image, b.b, r.root FROM reached r JOIN both_ways b ON b.image = r.image AND b.a = r.id WHERE r.root < b.b)
    SELECT image, id AS label, min(root) AS glued FROM reached GROUP BY 1, 2"""
)
def glued_regions(spark, d):
    """Small regions joined to what lies about them."""
    return regions.glued(voxels.labelled(X.pixels(spark, d).where("value > 0"), 64), 1, 30)


@query(
    f"""WITH RECURSIVE {X.BLOBS}, {X.PIXELS}, grid AS (SELECT image, y, x FROM (SELECT DISTINCT image FROM blobs), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x)), back AS (SELECT image, y, x FROM grid EXCEPT SELECT image, y, x FROM blobs),
    far AS (SELECT f.image, f.y, f.x, min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x)) AS square FROM blobs f JOIN back b ON f.image = b.image GROUP BY 1, 2, 3),
    centres AS (SELECT image, y AS cy, x AS cx, square FROM far QUALIFY row_number() OVER (PARTITION BY image ORDER BY square DESC, y, x) = 1), bright AS (SELECT image, y, x FROM pixels WHERE value >= 60), {_components('bright', 'spots')},
    each_one AS (SELECT s.image, label, sqrt(pow(avg(y) - min(cy), 2) + pow(avg(x) - min(cx), 2)) AS middle, min(sqrt(pow(y - cy, 2) + pow(x - cx, 2))) AS near FROM spots s JOIN centres c ON c.image = s.image GROUP BY 1, 2)
    SELECT c.image, cy, cx, round(sqrt(square), 6) AS radius, count(label) AS objects, round(coalesce(avg(middle), 0), 6) AS centroid_distance, round(coalesce(avg(near), 0), 6) AS nearest_distance FROM centres c LEFT JOIN each_one e ON e.image = c.image GROUP BY c.image, cy, cx, square"""
)
def inscribed_distances(spark, d):
    """Bright spots and the largest circle inside the touching objects of their image."""
    return rounded(regions.inscribed_distances(X.blobs(spark, d), voxels.labelled(X.pixels(spark, d).where("value >= 60"), 64), 64, 64))


@query()
def split_objects(spark, d):
    """Places of touching objects split along the ways of their skeletons; against the plain rule in the tests."""
    return splitting.split(X.blobs(spark, d), 64, 64, rest=True)


@query()
def split_layers(spark, d):
    """Layers without overlaps of the objects split."""
    return splitting.layers(splitting.split(X.blobs(spark, d), 64, 64, rest=True))


@query(
    """WITH RECURSIVE boxes AS (SELECT l_orderkey // 256 AS image, l_orderkey AS region, min(l_orderkey * 31) % 56 AS y0, min(l_partkey) * 7 % 56 AS x0, 3 + count(*) AS side FROM lineitem GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY region) AS k FROM boxes),
    before AS (SELECT b.image, b.region, b.k, coalesce(list(a.k) FILTER (WHERE a.k IS NOT NULL), []) AS earlier FROM ranked b LEFT JOIN ranked a ON a.image = b.image AND a.k < b.k
      AND a.y0 < b.y0 + b.side AND b.y0 < a.y0 + a.side AND a.x0 < b.x0 + b.side AND b.x0 < a.x0 + a.side GROUP BY 1, 2, 3),
    filled(image, k, held) AS (SELECT DISTINCT image, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM before
      UNION ALL SELECT f.image, b.k, list_append(f.held, list_min(list_filter(range(1, b.k + 1), lambda c: NOT list_contains(list_transform(b.earlier, lambda e: f.held[e]), c)))) FROM filled f JOIN before b ON b.image = f.image AND b.k = f.k + 1)
    SELECT b.image, b.region, CAST(f.held[b.k] AS INTEGER) AS layer FROM before b JOIN filled f USING (image, k)"""
)
def box_layers(spark, d):
    """Layers without overlaps of squares, an order each, in images of 64 by 64 places."""
    boxes = (
        X.table(spark, d, "lineitem")
        .groupBy((F.expr("l_orderkey div 256")).alias("image"), F.col("l_orderkey").alias("region"))
        .agg((F.min("l_orderkey") * 31 % 56).alias("y0"), (F.min("l_partkey") * 7 % 56).alias("x0"), (3 + F.count(F.lit(1))).alias("side"))
    )
    rows = boxes.repartition("image").select("image", "region", "x0", "side", F.explode(F.expr("sequence(y0, y0 + side - 1)")).alias("y"))
    return splitting.layers(rows.select("image", "region", "y", F.explode(F.expr("sequence(x0, x0 + side - 1)")).alias("x")))
