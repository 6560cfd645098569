"""Queries of where objects lie, and of small tables turned about."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import cluster, components, reshape, schema, voxels, zones
from mensura.plans import fixtures as X
from mensura.plans.fixtures import rounded
from mensura.plans.tests import _LABELS
from mensura.sources import tables as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


_PLACED = X.POINTS + ", placed AS (SELECT id % 8 AS image, id, (x + 0.5) * 64 AS x, (y + 0.5) * 64 AS y FROM points)"


def _placed(spark, d):
    return X.points(spark, d).select((F.col("id") % 8).alias("image"), "id", ((F.col("x") + 0.5) * 64).alias("x"), ((F.col("y") + 0.5) * 64).alias("y"))


@query(
    f"""WITH {_PLACED}, {X.MASK}, m AS (SELECT * FROM mask WHERE x < 8) SELECT p.image, p.id, round(min(sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2))), 6) AS distance FROM placed p LEFT JOIN m ON m.image = p.image GROUP BY 1, 2"""
)
def mask_distance(spark, d):
    """Distance of points to the nearest place of a structure."""
    return rounded(zones.distance_to_mask(_placed(spark, d), X.mask(spark, d).where("x < 8")))


_SQUARE = "(SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)"
_ZONE = f"near AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM mask, {_SQUARE} WHERE x < 8 AND y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63)"
_FLAGS = _LABELS + f""", {_ZONE}, l AS (SELECT image, label, avg(x) AS x, avg(y) AS y FROM labels GROUP BY 1, 2),
    dense AS (SELECT a.image, a.label, count(*) AS n FROM l a JOIN l b ON a.image = b.image AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 3 GROUP BY 1, 2),
    member AS (SELECT DISTINCT a.image, a.label FROM l a JOIN l b ON a.image = b.image AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 3 JOIN dense d ON d.image = b.image AND d.label = b.label AND d.n >= 5),
    flags AS (SELECT image, label, CAST((image, label) IN (SELECT (image, label) FROM labels JOIN near USING (image, y, x)) AS INTEGER) AS perinuclear,
      CAST((image, label) IN (SELECT (image, label) FROM labels WHERE x < 2 OR y < 2 OR x > 61 OR y > 61) AS INTEGER) AS edge, CAST((image, label) IN (SELECT (image, label) FROM member) AS INTEGER) AS clustered FROM l)"""


def _zone(spark, d):
    return zones.around(X.mask(spark, d).where("x < 8"), 64, 64, 2)


@query(
    f"""WITH RECURSIVE {_FLAGS} SELECT *, CAST(perinuclear = 0 AND edge = 0 AS INTEGER) AS cytoplasm, CAST(perinuclear = 0 AND edge = 1 AS INTEGER) AS edge_only, CAST(perinuclear = 1 AND edge = 0 AS INTEGER) AS perinuclear_only,
    CAST(perinuclear = 1 AND edge = 1 AS INTEGER) AS squished FROM flags"""
)
def context_flags(spark, d):
    """Objects near a structure, at the cell's edge, in dense places; and the flags that follow."""
    mask = X.mask(spark, d)
    labels = voxels.labelled(mask, 64)
    cell = mask.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    middles = voxels.region_props(labels).select(F.struct("image", "label").alias("id"), (F.col("cx") + F.col("image") * 1000).alias("x"), F.col("cy").alias("y"))  # images far apart
    dense = components.density_clusters(middles, 3.0, 5).where("cluster is not null").select("id.image", "id.label")
    flags = zones.context_flags(labels, {"perinuclear": _zone(spark, d), "edge": zones.rim(cell, 2)}, {"clustered": dense})
    return flags.withColumns(zones.exclusive_flags("perinuclear", "edge"))


@query(
    f"""WITH RECURSIVE {_LABELS}, {_ZONE}, a AS (SELECT image, count(*) AS area FROM near GROUP BY 1), k AS (SELECT image, count(DISTINCT label) AS labels FROM labels GROUP BY 1), i AS (SELECT image, count(DISTINCT label) AS n FROM labels JOIN near USING (image, y, x) GROUP BY 1)
    SELECT l.image, l.label, round(coalesce(n, 0) / area, 6) AS density, round(coalesce(n, 0) / labels, 6) AS share FROM (SELECT DISTINCT image, label FROM labels) l LEFT JOIN a USING (image) LEFT JOIN k USING (image) LEFT JOIN i USING (image)"""
)
def zone_density(spark, d):
    """Density and share of the objects near a structure, once an image, given to every object."""
    labels = voxels.labelled(X.mask(spark, d), 64)
    return rounded(zones.with_density(labels.select("image", "label").distinct(), labels, _zone(spark, d)))


@query(
    f"""WITH {X.OBJECTS}, s AS (SELECT subtype, avg(quantity) AS quantity, avg(price) AS price FROM objects GROUP BY 1), u AS (SELECT 'quantity' AS feature, subtype, quantity AS v FROM s UNION ALL SELECT 'price', subtype, price FROM s)
    SELECT feature, round(max(v) FILTER (WHERE subtype = 'A'), 4) AS "A", round(max(v) FILTER (WHERE subtype = 'N'), 4) AS "N", round(max(v) FILTER (WHERE subtype = 'R'), 4) AS "R" FROM u GROUP BY 1"""
)
def transposed_means(spark, d):
    means = X.objects(spark, d).groupBy("subtype").agg(F.avg("quantity").alias("quantity"), F.avg("price").alias("price"))
    return rounded(reshape.transposed(means, "subtype", ["A", "N", "R"], "feature"), 4)


@query(
    """SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment', 'c_nationkey']) AS name, unnest([count(DISTINCT c_custkey), count(DISTINCT c_name), count(DISTINCT c_mktsegment), count(DISTINCT c_nationkey)]) AS n,
    unnest([count(DISTINCT c_custkey) = count(*), count(DISTINCT c_name) = count(*), count(DISTINCT c_mktsegment) = count(*), count(DISTINCT c_nationkey) = count(*)]) AS is_unique FROM customer"""
)
def uniqueness(spark, d):
    return schema.uniqueness(S.table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


@query()
def ward_merges(spark, d):
    return rounded(cluster.linkage(X.embedded(spark, d)))


@query()
def ward_by_gap(spark, d):
    """Clusters left by a cut in the largest gap between merges."""
    return cluster.gap_labels(X.embedded(spark, d))
