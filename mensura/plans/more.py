"""Further queries: densities, variance models, label measures and cluster choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import aggregate, clean, cluster, models, reshape, scale, spatial, stats, tiles, tracking, voxels
from mensura.operators.quantiles import quantiles
from mensura.plans import fixtures as X
from mensura.plans.fixtures import rounded
from mensura.plans.tests import _LABELS, _frames
from mensura.sources import tables as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


@query(
    f"""WITH {X.POINTS}, e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points)
    SELECT CAST(least(floor((x - lx) / (hx - lx) * 8), 7) AS INTEGER) AS bin_x, CAST(least(floor((y - ly) / (hy - ly) * 8), 7) AS INTEGER) AS bin_y, count(*) AS n FROM points, e GROUP BY 1, 2"""
)
def point_density(spark, d):
    return stats.binned_density(X.points(spark, d), "x", "y", 8)


@query(
    f"""WITH {X.POINTS}, p AS (SELECT a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM points a JOIN points b ON a.id <> b.id)
    SELECT points.id, round((coalesce(sum(exp(-d * d / (2 * 0.02 * 0.02))) FILTER (WHERE d <= 0.08), 0) + 1) / ((SELECT count(*) FROM points) * 2 * pi() * 0.02 * 0.02), 6) AS density
    FROM points LEFT JOIN p USING (id) GROUP BY points.id"""
)
def kernel_density(spark, d):
    return rounded(stats.kernel_density(X.points(spark, d), 0.02))


@query(
    f"""WITH {X.FEATURES}, s AS (SELECT feature, subtype, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM features GROUP BY 1, 2),
    p AS (SELECT feature, count(*) AS k, sum(n) - count(*) AS df, sum(v * (n - 1)) / (sum(n) - count(*)) AS ms FROM s GROUP BY 1)
    SELECT a.feature, a.subtype AS group1, b.subtype AS group2, k, df, round(abs(a.m - b.m) / sqrt(ms / 2 * (1 / a.n + 1 / b.n)), 6) AS q FROM s a JOIN s b ON a.feature = b.feature AND a.subtype < b.subtype JOIN p ON p.feature = a.feature"""
)
def tukey_range(spark, d):
    return rounded(stats.tukey(X.features(spark, d), "subtype", ["feature"]).drop("p"))


@query(
    f"""WITH {X.OBJECTS}, y AS (SELECT subtype, condition, CAST(quantity AS DOUBLE) AS y, CAST(condition = 'O' AS DOUBLE) AS d FROM objects), a AS (SELECT count(*) * var_pop(y) AS yy, count(*) * covar_pop(y, d) AS yd, count(*) * var_pop(d) AS dd FROM y GROUP BY subtype),
    r AS (SELECT (SELECT sum(yy) FROM a) AS a, (SELECT sum(yy) - sum(yd) * sum(yd) / sum(dd) FROM a) AS ab, (SELECT sum(v) FROM (SELECT count(*) * var_pop(y) AS v FROM y GROUP BY condition)) AS b,
      (SELECT sum(v) FROM (SELECT count(*) * var_pop(y) AS v FROM y GROUP BY subtype, condition)) AS rest, (SELECT count(*) FROM y) - 6 AS free),
    o AS (SELECT 'subtype' AS factor, b - ab AS squares, 2 AS df1, free, rest FROM r UNION ALL SELECT 'condition', a - ab, 1, free, rest FROM r UNION ALL SELECT 'subtype:condition', ab - rest, 2, free, rest FROM r),
    f AS (SELECT factor, squares, df1, CAST(free AS INTEGER) AS df2, squares / df1 / (rest / free) AS f FROM o)
    SELECT factor, round(squares, 4) AS squares, df1, df2, round(f, 4) AS f, round(CASE WHEN df1 = 2 THEN pow(1 + 2 * f / df2, -df2 / 2) ELSE {X.t_p("sqrt(f)", "df2")} END, 4) AS p FROM f"""  # three subtypes, two conditions
)
def two_way_anova(spark, d):
    return rounded(stats.two_way_anova(X.objects(spark, d), "subtype", "condition", "quantity"), 4)


@query(
    f"""WITH {X.OBJECTS}, s AS (SELECT subtype, condition, count(*) AS n, avg(quantity) AS m, var_samp(quantity) AS v FROM objects GROUP BY 1, 2 HAVING count(*) >= 2),
    b AS (SELECT 'within_line' AS family, subtype AS place, condition AS g, n, m, v FROM s UNION ALL SELECT 'between_lines', condition, subtype, n, m, v FROM s),
    w AS (SELECT a.family, a.place, a.g AS group1, b.g AS group2, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
      (a.v / a.n + b.v / b.n) * (a.v / a.n + b.v / b.n) / ((a.v / a.n) * (a.v / a.n) / (a.n - 1) + (b.v / b.n) * (b.v / b.n) / (b.n - 1)) AS df FROM b a JOIN b b ON a.family = b.family AND a.place = b.place AND a.g < b.g),
    p AS (SELECT *, {X.t_p("t", "df")} AS p FROM w), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
    SELECT family, place AS "at", group1, group2, round(t, 5) AS t, round(df, 5) AS df, round(p, 5) AS p, round(least(max(p * (m - k + 1)) OVER (ORDER BY k), 1), 5) AS p_adj FROM k"""
)
def line_condition_tests(spark, d):
    return rounded(stats.line_and_condition(X.objects(spark, d), "subtype", "condition", "quantity"), 5)


ALPHA = 0.3  # the tables' groups hardly differ
_DUNN = X.PROFILES + f""", v AS (SELECT feature, value, count(*) AS c, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) - (count(*) - 1) / 2 AS rk FROM profiles GROUP BY 1, 2),
    g AS (SELECT feature, subtype, count(*) AS n, sum(rk) AS s FROM profiles JOIN v USING (feature, value) GROUP BY 1, 2), t AS (SELECT feature, sum(c) AS total, sum(CAST(c AS DOUBLE) * c * c - c) AS tie FROM v GROUP BY 1),
    h AS (SELECT feature, count(*) AS groups, min(n) AS smallest, (12 / (any_value(total) * (any_value(total) + 1.0)) * sum(s * s / n) - 3 * (any_value(total) + 1)) / (1 - any_value(tie) / (any_value(total) * 1.0 * any_value(total) * any_value(total) - any_value(total))) AS h FROM g JOIN t USING (feature) GROUP BY feature),
    kw AS (SELECT feature, groups, smallest, h, {X.chi2_p("h", "groups - 1")} AS p FROM h),
    z AS (SELECT a.feature, a.subtype AS group1, b.subtype AS group2, (a.s / a.n - b.s / b.n) / sqrt((total * (total + 1.0) / 12 - tie / (12 * (total - 1))) * (1 / a.n + 1 / b.n)) AS z
      FROM g a JOIN g b ON a.feature = b.feature AND a.subtype < b.subtype JOIN t ON t.feature = a.feature WHERE a.feature IN (SELECT feature FROM kw WHERE p < {ALPHA})),
    pz AS (SELECT *, {X.normal_p("z")} AS p FROM z), kz AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY p) AS k, count(*) OVER (PARTITION BY feature) AS m FROM pz),
    pairs AS (SELECT feature, group1, group2, z, p, least(min(p * m / k) OVER (PARTITION BY feature ORDER BY k DESC), 1) AS p_adj FROM kz),
    ends AS (SELECT feature, group1 AS grp, group2 AS other, p_adj FROM pairs UNION ALL SELECT feature, group2, group1, p_adj FROM pairs),
    partners AS (SELECT feature, grp AS group, count(*) FILTER (WHERE p_adj < {ALPHA}) AS n, coalesce(list(other ORDER BY other) FILTER (WHERE p_adj < {ALPHA}), []) AS others FROM ends GROUP BY 1, 2),
    called AS (SELECT *, CASE WHEN n >= 2 THEN 'differs_from_both' WHEN n = 1 THEN 'differs_from_exactly_one' ELSE 'differs_from_none' END AS category FROM partners)"""


def _pairs(spark, d):
    return stats.screened_dunn(X.profiles(spark, d), "subtype", ALPHA)


@query(
    f"""WITH {_DUNN}, k AS (SELECT feature, count(*) AS n_groups FROM called GROUP BY 1), c AS (SELECT feature, n_groups, max(n) AS most, count(*) FILTER (WHERE n = n_groups - 1) AS whole,
      count(*) FILTER (WHERE n > 1 AND n < n_groups - 1) AS part, count(*) FILTER (WHERE n = 1) AS one FROM called JOIN k USING (feature) GROUP BY 1, 2),
    d AS (SELECT feature, coalesce(list(group1 || ' vs ' || group2 ORDER BY group1 || ' vs ' || group2) FILTER (WHERE p_adj < {ALPHA}), []) AS differing, min(p_adj) AS lo, max(p_adj) AS hi FROM pairs GROUP BY 1)
    SELECT feature, n_groups, CASE WHEN whole = n_groups THEN 'all_differ' WHEN whole = 1 AND part = 0 AND one = n_groups - 1 THEN 'one_differ_from_all' WHEN whole = 2 AND part = 0 AND one = n_groups - 2 THEN 'two_differ_from_all'
      WHEN most <= 1 THEN 'only_pairwise' ELSE 'mixed' END AS topology, differing, CASE WHEN hi < {ALPHA} THEN 'all' WHEN lo >= {ALPHA} THEN 'none' ELSE 'partial' END AS extent FROM c JOIN d USING (feature)"""
)
def dunn_topology(spark, d):
    pairs = _pairs(spark, d)
    return stats.topology(pairs, ALPHA).join(stats.all_or_none(pairs, ALPHA), "feature")


@query(f"WITH {_DUNN} SELECT * FROM called")
def dunn_partners(spark, d):
    return stats.partners(_pairs(spark, d), ALPHA)


@query(
    f"""WITH {_DUNN}, e AS (SELECT p.feature, p.group1, p.group2, any_value(p_adj) AS p_adj, sum(sign(a.value - b.value)) / count(*) AS delta FROM pairs p JOIN profiles a ON a.feature = p.feature AND a.subtype = group1
      JOIN profiles b ON b.feature = p.feature AND b.subtype = group2 GROUP BY 1, 2, 3) SELECT feature, group1, group2, group1 || ' vs ' || group2 AS pair, round(p_adj, 5) AS p_adj, round(delta, 5) AS delta FROM e"""
)
def dunn_effects(spark, d):
    return rounded(stats.dunn_effects(X.profiles(spark, d), "subtype", ALPHA), 5)


@query(
    f"""WITH {_DUNN} SELECT r.row, count(*) FILTER (WHERE feature LIKE '%area%') AS area, count(*) FILTER (WHERE feature LIKE '%shape%') AS shape, count(*) FILTER (WHERE feature LIKE '%texture%') AS texture
    FROM (SELECT unnest({X.ORGANELLES}) AS row) r LEFT JOIN (SELECT DISTINCT feature FROM called WHERE "group" = 3 AND category = 'differs_from_none') ON contains(feature, r.row) GROUP BY 1"""
)
def difference_counts(spark, d):
    """Features by organelle and kind in which subtype 3 differs from none."""
    return stats.difference_counts(stats.partners(_pairs(spark, d), ALPHA), X.ORGANELLES, X.KINDS, "3", "none")


@query(
    f"""WITH {_DUNN}, f AS (SELECT feature, groups, smallest, h, p FROM kw WHERE smallest >= 3), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM f)
    SELECT feature, groups, smallest, round(h, 5) AS h, round(p, 5) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 5) AS p_adj FROM k"""
)
def kruskal_screen(spark, d):
    """Features that differ between subtypes, adjusted for their number."""
    return rounded(stats.adjusted(stats.kruskal(X.profiles(spark, d), "subtype").where("smallest >= 3")), 5)


@query(
    f"""WITH {X.OBJECTS}, c AS (SELECT subtype, count(*) FILTER (WHERE condition = 'F') AS x1, count(*) FILTER (WHERE condition = 'O') AS x2 FROM objects GROUP BY 1), n AS (SELECT *, CAST(sum(x1) OVER () AS BIGINT) AS n1, CAST(sum(x2) OVER () AS BIGINT) AS n2 FROM c),
    p AS (SELECT *, {X.fisher_p("x1", "(n1 - x1)", "x2", "(n2 - x2)")} AS p FROM n), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
    SELECT subtype, x1 AS count1, x2 AS count2, round(x1 / n1, 6) AS share1, round(x2 / n2, 6) AS share2, round(x2 / n2 - x1 / n1, 6) AS difference, CASE WHEN x2 / n2 > x1 / n1 THEN 'larger' WHEN x2 / n2 < x1 / n1 THEN 'smaller' ELSE 'same' END AS direction,
    round(CAST(x1 AS DOUBLE) * (n2 - x2) / ((n1 - x1) * x2), 6) AS odds, round(p, 5) AS p, round(least(max(p * (m - k + 1)) OVER (ORDER BY k), 1), 5) AS p_adj FROM k"""
)
def compared_proportions(spark, d):
    found = stats.compared_proportions(X.objects(spark, d), "subtype", "condition", "F", "O")
    return rounded(found.withColumns({c: F.round(c, 5) for c in ("p", "p_adj")}))


@query(
    f"""WITH {X.OBJECTS}, c AS (SELECT subtype, condition, quantity AS value, count(*) AS n FROM objects GROUP BY ALL), u AS (SELECT a.subtype, sum(a.n * b.n * CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS u, CAST(sum(a.n * b.n) AS DOUBLE) AS m
      FROM c a JOIN c b ON a.subtype = b.subtype AND a.condition = 'F' AND b.condition = 'O' GROUP BY 1), t AS (SELECT subtype, sum(k) AS n, sum(CAST(k AS DOUBLE) * k * k - k) AS tie FROM (SELECT subtype, quantity, count(*) AS k FROM objects GROUP BY 1, 2) GROUP BY 1),
    z AS (SELECT subtype, u, 2 * u / m - 1 AS delta, greatest(abs(u - m / 2) - 0.5, 0) / sqrt(m / 12 * (n + 1 - tie / (n * (n - 1.0)))) AS z FROM u JOIN t USING (subtype)),
    p AS (SELECT *, {X.normal_p("z")} AS p FROM z), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
    SELECT subtype, round(u, 1) AS u, round(delta, 6) AS delta, round(z, 6) AS z, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS p_adj FROM k"""
)
def mannwhitney_adjusted(spark, d):
    long = X.objects(spark, d).select("subtype", "condition", F.col("quantity").alias("value"))
    return rounded(stats.adjusted(stats.mann_whitney(long, "condition", "F", "O", ["subtype"])).select("subtype", "u", "delta", "z", "p", "p_adj"))


def _deaths(spark, d, terms):
    counts = X.objects(spark, d).groupBy("condition", "image").agg(F.sum((F.col("discount") > 0.05).cast("double")).alias("dead"), F.count(F.lit(1)).cast("double").alias("n"))
    return models.binomial_model(counts.withColumn("alive", F.col("n") - F.col("dead")), terms, "dead", "alive")


@query()
def glm_binomial(spark, d):
    return rounded(_deaths(spark, d, "condition * image")[1].select("condition", "image", "dead", "n", "fitted"))


@query()
def glm_coefficients(spark, d):
    """Terms of a model of deaths with errors and probabilities; against plain least squares in the tests."""
    return rounded(_deaths(spark, d, "condition + image")[0])


@query()
def pca_loadings(spark, d):
    """Loadings of the measures of objects; against an eigendecomposition in the tests."""
    return rounded(cluster.principal_loadings(X.objects(spark, d), ["quantity", "discount", "cell"], 2), 4)


@query(
    f"""WITH {X.OBJECTS}, s AS (SELECT image, order_id % 16 AS y, cell % 16 AS x, quantity FROM objects)
    SELECT image, y, x, round(stddev_pop(quantity), 6) AS value FROM s GROUP BY ALL"""
)
def z_projection(spark, d):
    stack = X.objects(spark, d).selectExpr("image", "order_id % 16 AS y", "cell % 16 AS x", "quantity")
    return rounded(voxels.projected(stack, "quantity", "std"))


@query(
    f"""WITH {X.OBJECTS}, s AS (SELECT image, order_id % 16 AS y, cell % 16 AS x, quantity FROM objects), m AS (SELECT image, y, x, quantile_cont(quantity, 0.5) AS med FROM s GROUP BY ALL)
    SELECT image, y, x, round(quantile_cont(abs(quantity - med), 0.5), 6) AS value FROM s JOIN m USING (image, y, x) GROUP BY ALL"""
)
def z_projection_mad(spark, d):
    stack = X.objects(spark, d).selectExpr("image", "order_id % 16 AS y", "cell % 16 AS x", "quantity")
    return rounded(voxels.projected(stack, "quantity", "mad"))


@query(f"WITH {X.OBJECTS} SELECT quantity AS v, round(sum(count(*)) OVER (ORDER BY quantity) / sum(count(*)) OVER (), 6) AS cdf FROM objects GROUP BY quantity")
def equalised_histogram(spark, d):
    return rounded(scale.distribution(X.objects(spark, d), "quantity"))


@query(f"WITH {X.MASK}, b AS (SELECT image, min(y) AS y0, min(x) AS x0 FROM mask GROUP BY 1) SELECT image, y - y0 + 2 AS y, x - x0 + 2 AS x FROM mask JOIN b USING (image)")
def cropped_mask(spark, d):
    return voxels.cropped(X.mask(spark, d), 2)


@query(
    f"""WITH RECURSIVE {_LABELS}, o AS (SELECT image, y, 63 - x AS x FROM mask) SELECT l.image, l.label, count(*) AS area, count(o.x) AS overlap, count(o.x) > 0.3 * count(*) AS positive
    FROM labels l LEFT JOIN o USING (image, y, x) GROUP BY ALL"""
)
def overlap_positive(spark, d):
    mask = X.mask(spark, d)
    return voxels.overlap_fraction(voxels.labelled(mask, 64), mask.withColumn("x", 63 - F.col("x")), 0.3)


@query(f"WITH RECURSIVE {_LABELS}, k AS (SELECT image, label FROM labels GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) < 5) SELECT image, y, x, label FROM labels JOIN k USING (image, label)")
def size_band(spark, d):
    return voxels.sized(voxels.labelled(X.mask(spark, d), 64), 2, 5)


@query(
    f"""WITH RECURSIVE {_LABELS}, t AS (SELECT image, label FROM labels GROUP BY 1, 2 HAVING min(x) = 0 OR min(y) = 0 OR max(x) = 63 OR max(y) = 63)
    SELECT image, label, count(*) AS area FROM labels WHERE (image, label) NOT IN (SELECT (image, label) FROM t) GROUP BY 1, 2"""
)
def clear_border(spark, d):
    kept = clean.clear_of_border(voxels.labelled(X.mask(spark, d), 64), ["image", "label"], 64, 64)
    return kept.groupBy("image", "label").agg(F.count(F.lit(1)).alias("area"))


@query(f"WITH RECURSIVE {_LABELS}, a AS (SELECT image, label, count(*) AS area FROM labels GROUP BY 1, 2) SELECT image, count(*) AS n, round(avg(area), 6) AS mean, max(area) AS most FROM a GROUP BY image")
def objects_by_frame(spark, d):
    props = voxels.region_props(voxels.labelled(X.mask(spark, d), 64))
    return rounded(props.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("mean"), F.max("area").alias("most")))


@query(
    """SELECT host, list(n ORDER BY n) AS numbers FROM (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) AS n FROM pages) WHERE n IS NOT NULL GROUP BY host"""
)
def stacks_by_basename(spark, d):
    parts = S.path_parts(F.col("url"))
    named = S.table(spark, d, "pages").select(parts["host"].alias("host"), parts["number"].alias("n")).where("n is not null")
    return named.groupBy("host").agg(F.sort_array(F.collect_list("n")).alias("numbers"))  # the frames of a stack


@query("SELECT c_custkey, c_mktsegment FROM customer")
def ordered_categories(spark, d):
    return reshape.in_order(S.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING", "AUTOMOBILE"])


@query(
    f"""WITH {X.MASK}, d AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM mask, (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dx) WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63),
    grid AS (SELECT image, y, x FROM (SELECT DISTINCT image FROM mask), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x)), back AS (SELECT image, y, x FROM grid EXCEPT SELECT image, y, x FROM d),
    e AS (SELECT d.image, d.y, d.x, min(pow(d.y - b.y, 2) + pow(d.x - b.x, 2)) AS square FROM d JOIN back b ON d.image = b.image GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY square DESC, y, x) AS k FROM e)
    SELECT image, round(sqrt(square), 6) AS depth, y, x FROM r WHERE k = 1"""
)
def edge_depth(spark, d):
    return rounded(tiles.deepest(voxels.dilated(X.mask(spark, d), 64, 64), 64, 64))


@query()
def enclosing_circles(spark, d):
    return rounded(spatial.enclosing_circles(X.points(spark, d), "cell"))


@query(
    f"""WITH {X.POINTS}, c AS (SELECT cell, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, atan2(avg(y), avg(x)) AS a FROM points GROUP BY 1), t AS (SELECT cell, degrees(0.5 * atan2(2 * xy, xx - yy) - a) AS t FROM c),
    m AS (SELECT cell, t - 180 * floor(t / 180) AS t FROM t) SELECT cell, round(least(t, 180 - t), 6) AS angle FROM m"""
)
def ellipse_orientation(spark, d):
    return rounded(spatial.orientation(spatial.centred(X.points(spark, d), "cell"), "cell"))


@query()
def matched_frames(spark, d):
    return tracking.match_frames(tracking.frame_overlaps(_frames(spark, d)))


@query()
def best_k_silhouette(spark, d):
    return rounded(cluster.best_k(X.embedded(spark, d)), 4)


@query()
def forest_folds(spark, d):
    return rounded(cluster.out_of_fold(X.embedded(spark, d).withColumn("label", F.col("given").cast("double")), "label", 3, trees=10, depth=6), 4)


@query()
def low_confidence_subtypes(spark, d):
    embedded = X.embedded(spark, d).withColumn("label", F.col("given").cast("double"))
    found = cluster.transferred(cluster.fit_forest(embedded, "label", 10, 6), embedded.drop("label"))
    kept = found.select("id", "features", "prediction", "confidence")
    return cluster.reclustered(kept, "confidence", 0.35, 2, "prediction").groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


@query()
def subtype_medians(spark, d):
    """Median profile of each K-means subtype."""
    flat = cluster.kmeans_labels(X.embedded(spark, d), 3)
    from pyspark.ml.functions import vector_to_array

    long = flat.select("cluster", F.posexplode(vector_to_array("features")).alias("feature", "value"))
    return rounded(quantiles(long, ["cluster", "feature"], "value", {"median": 0.5}), 4)


@query()
def new_and_lost_labels(spark, d):
    """Labels that come and go in each frame of a series."""
    frames = _frames(spark, d)
    tracks = tracking.track_ids(frames, tracking.mutual_best(tracking.frame_overlaps(frames)))
    lives = aggregate.lifetimes(tracks.withColumn("track", F.concat_ws("_", "first_t", "first_label")), ["series", "track"], "t")
    return lives.groupBy("series", "first_frame", "last_frame").agg(F.count(F.lit(1)).alias("n"))
