"""Queries of statistical tests, point patterns, clusters, masks and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import columns as C
from mensura.operators import aggregate as A
from mensura.operators import cluster, components, joins, reshape, spatial, stats, tracking, voxels
from mensura.plans import fixtures as X
from mensura.plans.fixtures import rounded
from mensura.sources import tables as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


_RANKED = X.FEATURES + """, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM features),
    g AS (SELECT feature, subtype, count(*) AS n, sum(rk) AS s FROM r GROUP BY 1, 2),
    t AS (SELECT feature, sum(c) AS total, sum(CAST(c AS DOUBLE) * c * c - c) AS tie FROM (SELECT feature, value, count(*) AS c FROM features GROUP BY 1, 2) GROUP BY 1)"""


@query(
    f"""WITH {_RANKED}, k AS (SELECT feature, count(*) AS groups, min(n) AS smallest,
    (12 / (any_value(total) * (any_value(total) + 1.0)) * sum(s * s / n) - 3 * (any_value(total) + 1)) / (1 - any_value(tie) / (any_value(total) * 1.0 * any_value(total) * any_value(total) - any_value(total))) AS h
    FROM g JOIN t USING (feature) GROUP BY feature) SELECT feature, groups, smallest, round(h, 4) AS h, round({X.chi2_p("h", "groups - 1")}, 4) AS p FROM k"""
)
def kruskal_h(spark, d):
    return rounded(stats.kruskal(X.features(spark, d), "subtype"), 4)


@query(
    f"""WITH {_RANKED}, z AS (SELECT a.feature, a.subtype AS group1, b.subtype AS group2,
    (a.s / a.n - b.s / b.n) / sqrt((total * (total + 1.0) / 12 - tie / (12 * (total - 1))) * (1 / a.n + 1 / b.n)) AS z
    FROM g a JOIN g b ON a.feature = b.feature AND a.subtype < b.subtype JOIN t ON t.feature = a.feature),
    p AS (SELECT *, {X.normal_p("z")} AS p FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY p) AS k, count(*) OVER (PARTITION BY feature) AS m FROM p)
    SELECT feature, group1, group2, round(z, 6) AS z, round(p, 6) AS p, round(least(min(p * m / k) OVER (PARTITION BY feature ORDER BY k DESC), 1), 6) AS p_adj FROM k"""
)
def dunn_z(spark, d):
    return rounded(stats.dunn(X.features(spark, d), "subtype"))


@query(
    f"""WITH {X.FEATURES}, c AS (SELECT feature, subtype, value, count(*) AS n FROM features GROUP BY 1, 2, 3)
    SELECT a.feature, a.subtype AS group1, b.subtype AS group2, round(sum(a.n * b.n * sign(a.value - b.value)) / sum(a.n * b.n), 6) AS delta
    FROM c a JOIN c b ON a.feature = b.feature AND a.subtype < b.subtype GROUP BY ALL"""
)
def cliffs_delta_pairs(spark, d):
    return rounded(stats.cliffs_delta_pairs(X.features(spark, d), "subtype"))


_MW = """, c AS (SELECT {by}, condition, value, count(*) AS n FROM {src} GROUP BY ALL),
    p AS (SELECT a.{by}, sum(a.n * b.n * CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS u, sum(a.n * b.n) AS m
    FROM c a JOIN c b ON a.{by} = b.{by} AND a.condition = 'F' AND b.condition = 'O' GROUP BY a.{by})"""


@query(
    f"WITH {X.OBJECTS}, src AS (SELECT subtype, condition, quantity AS value FROM objects)" + _MW.format(by="subtype", src="src")
    + " SELECT subtype, round(u, 1) AS u, round(2 * u / m - 1, 6) AS delta FROM p"
)
def mannwhitney_by_subtype(spark, d):
    long = X.objects(spark, d).select("subtype", "condition", F.col("quantity").alias("value"))
    return rounded(stats.mann_whitney(long, "condition", "F", "O", ["subtype"]).select("subtype", "u", "delta"))


@query(
    f"WITH {X.FEATURES}, src AS (SELECT subtype || ':' || feature AS k, condition, value FROM features)" + _MW.format(by="k", src="src")
    + """ SELECT split_part(k, ':', 1) AS subtype, round(max(2 * u / m - 1) FILTER (WHERE k LIKE '%:discount'), 6) AS discount, round(max(2 * u / m - 1) FILTER (WHERE k LIKE '%:quantity'), 6) AS quantity,
    round(max(2 * u / m - 1) FILTER (WHERE k LIKE '%:tax'), 6) AS tax FROM p GROUP BY 1"""
)
def effect_size_matrix(spark, d):
    deltas = stats.mann_whitney(X.features(spark, d), "condition", "F", "O", ["subtype", "feature"])
    return rounded(reshape.wide_form(deltas, ["subtype"], "feature", ["discount", "quantity", "tax"], "delta"))


_FLAGSHIP = f"""WITH {X.OBJECTS}, sh AS (SELECT cell, condition, count(*) FILTER (WHERE subtype = 'A') / count(*) AS a, count(*) FILTER (WHERE subtype = 'N') / count(*) AS n,
    count(*) FILTER (WHERE subtype = 'R') / count(*) AS r FROM objects GROUP BY ALL),
    l AS (SELECT cell, condition, ln(greatest(a, 1e-9)) AS a, ln(greatest(n, 1e-9)) AS n, ln(greatest(r, 1e-9)) AS r FROM sh),
    src AS (SELECT 'A' AS subtype, condition, round(a - (a + n + r) / 3, 9) AS value FROM l UNION ALL SELECT 'N', condition, round(n - (a + n + r) / 3, 9) FROM l
    UNION ALL SELECT 'R', condition, round(r - (a + n + r) / 3, 9) FROM l)""" + _MW.format(by="subtype", src="src")


@query(_FLAGSHIP + " SELECT subtype, round(u, 1) AS u, round(2 * u / m - 1, 6) AS delta FROM p")
def composition_clr_mannwhitney(spark, d):
    """Subtype composition of cells in log-ratios, compared between conditions."""
    names = ["A", "N", "R"]
    shares = A.composition(X.objects(spark, d), ["cell", "condition"], "subtype", names)
    ratios = shares.select("cell", "condition", *[F.round(c, 9).alias(n) for n, c in C.centred_log_ratio(names).items()])
    long = reshape.long_form(ratios, ["cell", "condition"], names, "subtype")
    return rounded(stats.mann_whitney(long, "condition", "F", "O", ["subtype"]).select("subtype", "u", "delta"))


@query(
    f"""WITH {X.TRACKS}, s AS (SELECT line, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM tracks GROUP BY line HAVING count(value) >= 2)
    , w AS (SELECT a.line AS group1, b.line AS group2, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
    (a.v / a.n + b.v / b.n) * (a.v / a.n + b.v / b.n) / ((a.v / a.n) * (a.v / a.n) / (a.n - 1) + (b.v / b.n) * (b.v / b.n) / (b.n - 1)) AS df FROM s a JOIN s b ON a.line < b.line),
    p AS (SELECT *, {X.t_p("t", "df")} AS p FROM w), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
    SELECT group1, group2, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS p_adj FROM k"""
)
def welch_pairs(spark, d):
    """Welch's tests of all pairs of lines, adjusted for their number."""
    return rounded(stats.welch(X.tracks(spark, d), "line", []).withColumn("df", F.round("df", 4)))


_F = """SELECT count(*) - 1 AS df1, sum(n) - count(*) AS df2, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(v * (n - 1)) / (sum(n) - count(*))) AS f"""


@query(
    f"""WITH {X.FEATURES}, s AS (SELECT feature, subtype, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM features GROUP BY 1, 2), o AS ({_F}, feature FROM s GROUP BY feature)
    SELECT feature, df1, df2, round(f, 4) AS f, round(pow(1 + 2 * f / df2, -df2 / 2), 4) AS p FROM o"""  # three groups
)
def anova_f(spark, d):
    return rounded(stats.anova(X.features(spark, d), "subtype", ["feature"]), 4)


@query(
    f"""WITH {X.FEATURES}, z AS (SELECT feature, subtype, quantile_cont(value, 0.5) AS med FROM features GROUP BY 1, 2),
    y AS (SELECT f.feature, f.subtype, abs(f.value - z.med) AS value FROM features f JOIN z USING (feature, subtype)),
    s AS (SELECT feature, subtype, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM y GROUP BY 1, 2), o AS ({_F}, feature FROM s GROUP BY feature)
    SELECT feature, df1, df2, round(f, 4) AS w, round(pow(1 + 2 * f / df2, -df2 / 2), 4) AS p FROM o"""  # three groups
)
def levene_w(spark, d):
    return rounded(stats.levene(X.features(spark, d), "subtype", ["feature"]), 4)


@query(
    """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
    s AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM e GROUP BY 1, 2), o AS (""" + _F + """, feature FROM s GROUP BY feature)
    SELECT feature, round(f, 4) AS f FROM o"""
)
def anova_relevance(spark, d):
    flat = S.table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))
    return rounded(stats.anova(flat, "label", ["feature"]).select("feature", "f"), 4)


_CELLS = """c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb, sum(n) OVER () AS t FROM c)"""


@query(
    f"""WITH {_CELLS} SELECT a AS l_returnflag, b AS l_linestatus, n, round(ra * cb / t, 6) AS expected, round((n - ra * cb / t) / sqrt(ra * cb / t), 6) AS residual,
    round((n - ra * cb / t) / sqrt(ra * cb / t) / sqrt((1 - ra / t) * (1 - cb / t)), 6) AS adjusted, CAST(t AS BIGINT) AS total FROM e"""
)
def chi2_residuals(spark, d):
    return rounded(stats.contingency(S.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query(
    f"""WITH {_CELLS}, x AS (SELECT sum((n - ra * cb / t) * (n - ra * cb / t) / (ra * cb / t)) AS chi2, max(t) AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM e)
    SELECT round(chi2, 6) AS chi2, (r - 1) * (c - 1) AS df, round(sqrt(chi2 / (t * (least(r, c) - 1))), 6) AS v, round({X.chi2_p("chi2", "(r - 1) * (c - 1)")}, 6) AS p FROM x"""
)
def cramers_v(spark, d):
    return rounded(stats.cramers_v(S.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


_TABLES = f"""{X.OBJECTS}, q AS (SELECT image, count(*) FILTER (WHERE condition = 'F' AND discount > 0.05) AS a, count(*) FILTER (WHERE condition = 'F' AND discount <= 0.05) AS b,
    count(*) FILTER (WHERE condition = 'O' AND discount > 0.05) AS c, count(*) FILTER (WHERE condition = 'O' AND discount <= 0.05) AS d FROM objects GROUP BY image)"""


def _tables(spark, d):
    high, f = F.col("discount") > 0.05, F.col("condition") == "F"
    counts = [F.count(F.when(t, 1)).alias(n) for n, t in (("a", f & high), ("b", f & ~high), ("c", ~f & high), ("d", ~f & ~high))]
    return X.objects(spark, d).groupBy("image").agg(*counts)


@query(
    f"""WITH {_TABLES}, x AS (SELECT image, a, b, c, d, (a + b + c + d) * pow(CAST(a AS DOUBLE) * d - b * c, 2) / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS chi2,
    round(CAST(a AS DOUBLE) * d / (b * c), 6) AS odds, least((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / (a + b + c + d) < 5 AS exact, round(a / (a + b) - c / (c + d), 6) AS difference FROM q)
    SELECT * REPLACE (round(chi2, 6) AS chi2), round(CASE WHEN exact THEN {X.fisher_p("a", "b", "c", "d")} ELSE {X.chi2_p("chi2", "1")} END, 5) AS p FROM x"""
)
def fisher_2x2(spark, d):
    return rounded(stats.two_by_two(_tables(spark, d), ["image"]).withColumn("p", F.round("p", 5)))


@query(
    f"""WITH {_TABLES}, w AS (SELECT image, a AS x1, a + b AS n1, c AS x2, c + d AS n2, (a + c) / (a + b + c + d) AS p, a / (a + b) AS s FROM q)
    SELECT image, x1, n1, x2, n2, round((x1 / n1 - x2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 6) AS z,
    round((s + 1.959964 * 1.959964 / (2 * n1) - 1.959964 * sqrt(s * (1 - s) / n1 + 1.959964 * 1.959964 / (4.0 * n1 * n1))) / (1 + 1.959964 * 1.959964 / n1), 6) AS low,
    round((s + 1.959964 * 1.959964 / (2 * n1) + 1.959964 * sqrt(s * (1 - s) / n1 + 1.959964 * 1.959964 / (4.0 * n1 * n1))) / (1 + 1.959964 * 1.959964 / n1), 6) AS high,
    round({X.normal_p("(x1 / n1 - x2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2))")}, 6) AS p FROM w"""
)
def prop_z_wilson(spark, d):
    counts = _tables(spark, d).selectExpr("image", "a AS x1", "a + b AS n1", "c AS x2", "c + d AS n2")
    low, high = stats.wilson(F.col("x1"), F.col("n1"))
    return rounded(stats.two_proportions(counts, ["image"]).withColumns({"low": low, "high": high}))


@query(
    f"""WITH {X.OBJECTS}, q AS (SELECT cell, round(avg(discount) * 0.5, 9) AS p FROM objects GROUP BY cell), k AS (SELECT cell, p, row_number() OVER (ORDER BY p, cell) AS k, count(*) OVER () AS m FROM q)
    SELECT cell, p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS bh, round(least(max(p * (m - k + 1)) OVER (ORDER BY k), 1), 6) AS holm, round(least(p * m, 1), 6) AS bonferroni FROM k"""
)
def bh_holm_adjust(spark, d):
    table = X.objects(spark, d).groupBy("cell").agg(F.round(F.avg("discount") * 0.5, 9).alias("p"))
    for how, name in (("fdr_bh", "bh"), ("holm", "holm"), ("bonferroni", "bonferroni")):
        table = stats.adjusted(table, how=how, out=name)
    return table.select("cell", "p", *[F.round(c, 6).alias(c) for c in ("bh", "holm", "bonferroni")])


@query(
    f"""WITH {X.OBJECTS} SELECT unnest(['quantity', 'quantity', 'quantity', 'price', 'price', 'discount']) AS feature1, unnest(['price', 'discount', 'tax', 'discount', 'tax', 'tax']) AS feature2,
    round(unnest([corr(quantity, price), corr(quantity, discount), corr(quantity, tax), corr(price, discount), corr(price, tax), corr(discount, tax)]), 6) AS r FROM objects"""
)
def correlation_pairs(spark, d):
    return rounded(stats.correlations(X.objects(spark, d), X.MEASURES))


@query(
    f"""WITH {X.OBJECTS}, m AS (SELECT subtype, quantile_cont(price, 0.5) AS med FROM objects GROUP BY 1), o AS (SELECT subtype, price, row_number() OVER (PARTITION BY subtype ORDER BY price) AS i, count(*) OVER (PARTITION BY subtype) AS n FROM objects),
    g AS (SELECT subtype, 2 * sum(i * price) / (any_value(n) * sum(price)) - (any_value(n) + 1) / any_value(n) AS gini FROM o GROUP BY 1)
    SELECT subtype, round(skewness(price) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skew, round(stddev_pop(price) / avg(price), 6) AS cv, round(quantile_cont(abs(price - med), 0.5), 4) AS mad, round(any_value(gini), 6) AS gini
    FROM objects JOIN m USING (subtype) JOIN g USING (subtype) GROUP BY subtype"""
)
def distance_dispersion(spark, d):
    found = stats.dispersion(X.objects(spark, d), ["subtype"], "price")
    return found.select("subtype", F.round("skew", 6).alias("skew"), F.round("cv", 6).alias("cv"), F.round("mad", 4).alias("mad"), F.round("gini", 6).alias("gini"))


_OFF = X.POINTS + ", o AS (SELECT *, x - avg(x) OVER (PARTITION BY cell) AS dx, y - avg(y) OVER (PARTITION BY cell) AS dy FROM points)"


def _offsets(spark, d):
    return spatial.centred(X.points(spark, d), "cell")


@query(f"WITH {_OFF} SELECT cell, round(sqrt(avg(dx * dx) + avg(dy * dy)), 6) AS distance FROM o GROUP BY cell")
def standard_distance(spark, d):
    return rounded(spatial.standard_distance(_offsets(spark, d), "cell"))


@query(
    f"""WITH {_OFF}, s AS (SELECT cell, sum(dx * dx) AS xx, sum(dy * dy) AS yy, sum(dx * dy) AS xy, count(*) AS n FROM o GROUP BY cell), t AS (SELECT *, 0.5 * atan2(2 * xy, xx - yy) AS theta FROM s),
    e AS (SELECT cell, theta, sqrt(2 * (xx * cos(theta) * cos(theta) + 2 * xy * cos(theta) * sin(theta) + yy * sin(theta) * sin(theta)) / n) AS a,
    sqrt(2 * (xx * sin(theta) * sin(theta) - 2 * xy * cos(theta) * sin(theta) + yy * cos(theta) * cos(theta)) / n) AS b FROM t)
    SELECT cell, round(a, 6) AS major, round(b, 6) AS minor, round(theta, 6) AS theta, round(b / a, 6) AS ratio FROM e"""
)
def deviational_ellipse(spark, d):
    return rounded(spatial.deviational_ellipse(_offsets(spark, d), "cell"))


@query(
    f"""WITH {_OFF}, u AS (SELECT cell, sum(dx / sqrt(dx * dx + dy * dy)) AS c, sum(dy / sqrt(dx * dx + dy * dy)) AS s, count(*) AS n FROM o WHERE dx <> 0 OR dy <> 0 GROUP BY cell)
    SELECT cell, round(sqrt(c * c + s * s) / n, 6) AS length, round(atan2(s, c), 6) AS direction FROM u"""
)
def polarisation(spark, d):
    return rounded(spatial.polarisation(_offsets(spark, d), "cell"))


@query(
    f"""WITH {X.POINTS}, n AS (SELECT a.cell, a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS dist FROM points a JOIN points b ON a.cell = b.cell AND a.id <> b.id GROUP BY 1, 2),
    m AS (SELECT cell, avg(dist) AS observed FROM n GROUP BY 1), b AS (SELECT cell, count(*) AS k, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM points GROUP BY 1)
    SELECT cell, round(observed, 6) AS observed, round(0.5 / sqrt(k / area), 6) AS expected, round(observed / (0.5 / sqrt(k / area)), 6) AS ratio FROM m JOIN b USING (cell)"""
)
def ann_index(spark, d):
    return rounded(spatial.nearest_neighbour_ratio(X.points(spark, d), "cell", 0.05))


@query(f"WITH {X.POINTS} SELECT a.cell, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS diameter FROM points a JOIN points b ON a.cell = b.cell GROUP BY 1")
def max_feret(spark, d):
    return rounded(spatial.hull_measures(X.points(spark, d), "cell").select("cell", "diameter"))


@query()
def hull_props(spark, d):
    return rounded(spatial.hull_measures(X.points(spark, d), "cell"))


@query()
def random_polarity(spark, d):
    return rounded(spatial.random_polarisation(_offsets(spark, d), "cell", spatial.outlined(X.points(spark, d), "cell")))


@query(
    f"""WITH {X.POINTS} SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM points a JOIN points b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02"""
)
def radius_pairs(spark, d):
    return rounded(joins.within_radius(X.points(spark, d), 0.02))


_DB = X.POINTS + """, e AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.03),
    k AS (SELECT p.id, count(e.b) + 1 >= 4 AS core FROM points p LEFT JOIN e ON e.a = p.id GROUP BY 1), ce AS (SELECT a, b FROM e JOIN k x ON x.id = a AND x.core JOIN k y ON y.id = b AND y.core),
    walk(id, root) AS (SELECT id, id FROM k WHERE core UNION SELECT ce.b, w.root FROM walk w JOIN ce ON ce.a = w.id WHERE w.root < ce.b), roots AS (SELECT id, min(root) AS root FROM walk GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {_DB} SELECT k.id, k.core, coalesce(r.root, min(n.root)) AS cluster FROM k LEFT JOIN roots r ON r.id = k.id LEFT JOIN e ON e.a = k.id LEFT JOIN roots n ON n.id = e.b GROUP BY k.id, k.core, r.root"""
)
def dbscan_points(spark, d):
    return components.density_clusters(X.points(spark, d), 0.03, 4)


@query(
    f"""WITH RECURSIVE {X.POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02),
    walk(id, root) AS (SELECT id, id FROM points UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.id WHERE w.root < e.b) SELECT id, min(root) AS root FROM walk GROUP BY 1"""
)
def merge_components(spark, d):
    return components.near_components(X.points(spark, d), 0.02)


def _silhouettes(apart: str, then: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.id, a.label, b.label AS other, sum({apart}) AS s, count(*) AS n FROM e a JOIN e b ON true GROUP BY ALL),
    ab AS (SELECT id, label, max(CASE WHEN label = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM p GROUP BY ALL),
    s AS (SELECT id, label AS given, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab) {then}"""


_SQUARED = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))"


@query(_silhouettes(f"sqrt({_SQUARED})", "SELECT id, given, round(silhouette, 6) AS silhouette FROM s"))
def silhouette_samples(spark, d):
    return rounded(cluster.silhouettes(X.embedded(spark, d), "given"))


@query(_silhouettes(_SQUARED, "SELECT id, given, round(silhouette, 6) AS silhouette FROM s"))
def squared_silhouettes(spark, d):
    return rounded(cluster.squared_silhouettes(X.embedded(spark, d), "given"))


@query(
    _silhouettes(
        f"sqrt({_SQUARED})",
        """SELECT given, count(*) AS n, round(avg(silhouette), 6) AS mean, round(stddev_samp(silhouette) / sqrt(count(*)), 6) AS sem, round(stddev_samp(silhouette), 6) AS std,
        round(min(silhouette), 6) AS least, round(max(silhouette), 6) AS most FROM s GROUP BY given""",
    )
)
def silhouette_summary(spark, d):
    return rounded(A.described(cluster.silhouettes(X.embedded(spark, d), "given"), ["given"], "silhouette"))


@query()
def kmeans_subtypes(spark, d):
    return cluster.kmeans_labels(X.embedded(spark, d), 4).select("id", "cluster")


@query()
def ward_subtypes(spark, d):
    return cluster.ward_labels(X.embedded(spark, d), 4)


@query()
def pca_scores(spark, d):
    return rounded(cluster.principal_scores(X.embedded(spark, d), 3), 4)


@query()
def rf_transfer(spark, d):
    embedded = X.embedded(spark, d).withColumn("label", F.col("given").cast("double"))
    model = cluster.fit_forest(embedded.where("id % 2 = 0"), "label", 20, 8)
    found = cluster.transferred(model, embedded.where("id % 2 = 1"))
    return rounded(found.select("id", "given", "prediction", "confidence", "margin", "entropy"))


@query()
def gap_statistic(spark, d):
    return rounded(cluster.gap_statistic(X.embedded(spark, d), 3, 2), 4)


@query()
def mrmr_features(spark, d):
    table = X.objects(spark, d)
    return rounded(cluster.relevance(table, X.MEASURES, "subtype", 4), 4)


@query()
def bootstrap_q75(spark, d):
    return rounded(A.described(stats.bootstrap_quantile(X.tracks(spark, d), "line", "value"), ["line"], "quantile"))


@query()
def bootstrap_differences(spark, d):
    """Whether lines differ in their upper quartile, adjusted for the pairs."""
    boot = stats.bootstrap_quantile(X.tracks(spark, d), "line", "value")
    return rounded(stats.adjusted(stats.bootstrap_differences(boot, "line")))


@query(f"WITH {X.OBJECTS}, t AS (SELECT unnest([10, 25, 40]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(DISTINCT (order_id % 8, order_id // 8 % 64, image)) AS n FROM t, objects WHERE quantity >= threshold GROUP BY 1")
def mask_threshold(spark, d):
    pixels = X.objects(spark, d).selectExpr("order_id % 8 AS image", "(order_id div 8) % 64 AS y", "image AS x", "quantity")
    return voxels.thresholded(pixels, "quantity", [10.0, 25.0, 40.0]).distinct().groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


_NEAR = "(SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b"


@query(f"WITH {X.MASK} SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM mask, {_NEAR} WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63")
def mask_dilate(spark, d):
    return voxels.dilated(X.mask(spark, d), 64, 64)


@query(f"WITH {X.MASK}, m AS (SELECT image, y + dy AS y, x + dx AS x, count(*) AS n FROM mask, {_NEAR} WHERE abs(dy) + abs(dx) <= 1 GROUP BY ALL) SELECT image, y, x FROM m WHERE n = 5")
def mask_erode(spark, d):
    return voxels.eroded(X.mask(spark, d), "cross")


@query(f"WITH {X.MASK}, o AS (SELECT image, y, 63 - x AS x FROM mask) SELECT 'and' AS how, count(*) AS n FROM (SELECT * FROM mask INTERSECT SELECT * FROM o) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM mask UNION SELECT * FROM o) UNION ALL SELECT 'subtract', count(*) FROM (SELECT * FROM mask EXCEPT SELECT * FROM o) UNION ALL SELECT 'xor', count(*) FROM ((SELECT * FROM mask EXCEPT SELECT * FROM o) UNION (SELECT * FROM o EXCEPT SELECT * FROM mask))")
def mask_algebra(spark, d):
    mask = X.mask(spark, d)
    flipped = mask.withColumn("x", 63 - F.col("x"))
    # counted one by one, so that an empty result has a row too
    counts = {how: voxels.combined(mask, flipped, how).agg(F.count(F.lit(1)).alias("n")) for how in ("and", "or", "subtract", "xor")}
    return reshape.tagged_union(counts, "how").select("how", "n")


_LABELS = X.MASK + f""", n AS (SELECT image * 4096 + y * 64 + x AS id, image, y, x FROM mask), e AS (SELECT p.id AS a, q.id AS b FROM n p, {_NEAR}, n q WHERE q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx AND p.id <> q.id),
    walk(id, root) AS (SELECT id, id FROM n UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.id WHERE w.root < e.b), roots AS (SELECT id, min(root) % 4096 AS label FROM walk GROUP BY 1),
    labels AS (SELECT image, y, x, label FROM n JOIN roots USING (id))"""


@query(f"WITH RECURSIVE {_LABELS} SELECT image, y, x, label FROM labels")
def label_components(spark, d):
    return voxels.labelled(X.mask(spark, d), 64)


@query(
    f"""WITH RECURSIVE {_LABELS} SELECT image, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx,
    round(var_pop(y), 6) AS vy, round(var_pop(x), 6) AS vx, round(covar_pop(y, x), 6) AS vyx FROM labels GROUP BY image, label"""
)
def region_props(spark, d):
    return rounded(voxels.region_props(voxels.labelled(X.mask(spark, d), 64)))


@query(
    f"""WITH RECURSIVE {_LABELS}, z AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM mask, {_NEAR} WHERE x < 8), m AS (SELECT l.image, l.label, max(CAST(z.x IS NOT NULL AS INTEGER)) AS hit FROM labels l LEFT JOIN z USING (image, y, x) GROUP BY ALL)
    SELECT image, CAST(sum(hit) AS BIGINT) AS in_zone, count(*) AS labels, round(sum(hit) / count(*), 6) AS share FROM m GROUP BY image"""
)
def zone_object_counts(spark, d):
    mask = X.mask(spark, d)
    return rounded(voxels.zone_counts(voxels.labelled(mask, 64), mask.where("x < 8"), 64, 64))


@query(
    f"""WITH RECURSIVE {_LABELS}, p AS (SELECT a.image, a.label, b.label AS other, min(abs(a.y - b.y) + abs(a.x - b.x)) AS d FROM labels a JOIN labels b ON a.image = b.image AND a.label <> b.label AND abs(a.y - b.y) + abs(a.x - b.x) <= 4 GROUP BY ALL),
    q AS (SELECT image, label, min(d) AS d, count(*) AS k FROM p GROUP BY 1, 2) SELECT l.image, l.label, greatest(d - 1, 0) AS steps, coalesce(k, 0) AS neighbours FROM (SELECT DISTINCT image, label FROM labels) l LEFT JOIN q USING (image, label)"""
)
def neighbour_steps(spark, d):
    return voxels.neighbour_steps(voxels.labelled(X.mask(spark, d), 64), 4)


_BACK = (
    X.MASK
    + f""", d AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM mask, {_NEAR} WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63),
    back AS (SELECT image, y, x FROM (SELECT DISTINCT image FROM mask), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x) EXCEPT SELECT image, y, x FROM d),
    walk(image, y, x) AS (SELECT image, y, x FROM back WHERE y IN (0, 63) OR x IN (0, 63)
      UNION SELECT b.image, b.y, b.x FROM walk w, (SELECT unnest([0, 0, 1, -1]) AS dy, unnest([1, -1, 0, 0]) AS dx) s, back b WHERE b.image = w.image AND b.y = w.y + dy AND b.x = w.x + dx)"""
)


@query(f"WITH RECURSIVE {_BACK} SELECT image, y, x FROM d UNION (SELECT image, y, x FROM back EXCEPT SELECT image, y, x FROM walk)")
def filled_mask(spark, d):
    return voxels.filled(voxels.dilated(X.mask(spark, d), 64, 64), 64, 64)


@query(
    f"""WITH RECURSIVE {_BACK}, hole AS (SELECT image, y, x FROM back EXCEPT SELECT image, y, x FROM walk), inner_walk(image, y, x, root) AS (SELECT image, y, x, y * 64 + x FROM hole
      UNION SELECT h.image, h.y, h.x, w.root FROM inner_walk w, (SELECT unnest([0, 0, 1, -1]) AS dy, unnest([1, -1, 0, 0]) AS dx) s, hole h WHERE h.image = w.image AND h.y = w.y + dy AND h.x = w.x + dx AND w.root < h.y * 64 + h.x)
    SELECT image, y, x, min(root) AS label FROM inner_walk GROUP BY 1, 2, 3"""
)
def mask_holes(spark, d):
    return voxels.holes(voxels.dilated(X.mask(spark, d), 64, 64), 64, 64)


@query(
    f"""WITH {X.OBJECTS}, h AS (SELECT CAST(least(floor(quantity / 5.0), 9) AS INTEGER) AS bin, count(*) AS n FROM objects WHERE quantity BETWEEN 0 AND 50 GROUP BY 1),
    s AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w0, sum(n * bin) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM h),
    b AS (SELECT bin, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) / w / w, 9) AS between FROM s WHERE w0 < w) SELECT bin, round(between, 6) AS between FROM b ORDER BY between DESC, bin LIMIT 1"""
)
def otsu_threshold(spark, d):
    return rounded(voxels.otsu(X.objects(spark, d), "quantity", 0.0, 50.0, 10))


def _frames(spark, d):
    """Moving labels: the thin mask's rows as frames of a series."""
    return voxels.labelled(X.mask(spark, d), 64).select(F.lit(0).cast("long").alias("series"), F.col("image").cast("long").alias("t"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast("long").alias("label"))


@query(
    f"""WITH RECURSIVE {_LABELS}, o AS (SELECT b.image AS t, a.label AS a, b.label AS b, count(*) AS k FROM labels a JOIN labels b ON b.image = a.image + 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL),
    f AS (SELECT t, a, b, row_number() OVER (PARTITION BY t, a ORDER BY k DESC, b) AS i, row_number() OVER (PARTITION BY t, b ORDER BY k DESC, a) AS j FROM o) SELECT CAST(0 AS BIGINT) AS series, t, a, b FROM f WHERE i = 1 AND j = 1"""
)
def mutual_best_matches(spark, d):
    return tracking.mutual_best(tracking.frame_overlaps(_frames(spark, d)))


@query()
def tracked_objects(spark, d):
    frames = _frames(spark, d)
    return tracking.track_ids(frames, tracking.match_frames(tracking.frame_overlaps(frames)))
