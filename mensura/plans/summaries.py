"""Queries of aggregation, windows and scaling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mensura.functions import columns as C
from mensura.operators import aggregate as A
from mensura.operators import scale, schema
from mensura.plans import fixtures as X
from mensura.plans.fixtures import rounded
from mensura.sources import tables as S
from mensura.streaming import windows as W

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _summary(c: str, more: bool = True) -> str:
    skew = f"CASE WHEN count({c}) > 2 THEN round(skewness({c}), 6) END"
    rest = f", round(quantile_cont({c}, 0.5), 6) AS {c}_median, round(stddev_samp({c}), 6) AS {c}_std, {skew} AS {c}_skew" if more else ""
    return f"round(avg({c}), 6) AS {c}_mean{rest}"


@query(f"WITH {X.OBJECTS} SELECT cell, {_summary('quantity')}, {_summary('tax')}, round(avg(k), 6) AS k_mean FROM (SELECT *, 2.0 AS k FROM objects) GROUP BY cell")
def summary_stats_varying(spark, d):
    table = X.objects(spark, d).select("cell", "quantity", "tax", F.lit(2.0).alias("k"))
    return rounded(A.summarised(table, "cell"))


@query(
    f"""WITH {X.OBJECTS} SELECT cell, {_summary('quantity', False)}, round(quantile_cont(quantity, 0.5), 6) AS quantity_median, round(stddev_samp(quantity), 6) AS quantity_std,
    CASE WHEN stddev_samp(quantity) >= 14.2 THEN round(skewness(quantity), 6) ELSE 0 END AS quantity_skew FROM objects GROUP BY cell"""
)
def summary_stats_all(spark, d):
    return rounded(A.summarised(X.objects(spark, d), "cell", ["quantity"], only_varying=False, least_deviation=14.2))


@query(
    f"""WITH {X.TRACKS} SELECT line, frame, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, round(stddev_samp(value), 6) AS std,
    round(min(value), 6) AS least, round(max(value), 6) AS most FROM tracks GROUP BY 1, 2"""
)
def named_agg_sem(spark, d):
    return rounded(A.described(X.tracks(spark, d), ["line", "frame"], "value"))


@query(
    f"""WITH {X.OBJECTS} SELECT condition, subtype, image, sum(quantity) AS cells, sum(CASE WHEN discount > 0.05 THEN quantity ELSE 0 END) AS dead,
    round(sum(CASE WHEN discount > 0.05 THEN quantity ELSE 0 END) / sum(quantity), 6) AS rate FROM objects GROUP BY ALL"""
)
def death_rates(spark, d):
    dead = F.sum(F.when(F.col("discount") > 0.05, F.col("quantity")).otherwise(0.0)).alias("dead")
    sums = X.objects(spark, d).groupBy("condition", "subtype", "image").agg(F.sum("quantity").alias("cells"), dead)
    return rounded(sums.withColumn("rate", C.ratio(F.col("dead"), F.col("cells"))))


@query(
    f"""WITH {X.OBJECTS} SELECT cell, condition, round(count(*) FILTER (WHERE subtype = 'A') / count(*), 6) AS "A", round(count(*) FILTER (WHERE subtype = 'N') / count(*), 6) AS "N",
    round(count(*) FILTER (WHERE subtype = 'R') / count(*), 6) AS "R" FROM objects GROUP BY ALL"""
)
def composition_wide(spark, d):
    return rounded(A.composition(X.objects(spark, d), ["cell", "condition"], "subtype", ["A", "N", "R"]))


@query(f"WITH {X.OBJECTS} SELECT subtype, count(*) AS n, round(count(*) / (SELECT count(*) FROM objects), 6) AS share FROM objects GROUP BY subtype")
def composition_overall(spark, d):
    return rounded(A.shares(X.objects(spark, d), "subtype"))


@query(
    f"""WITH {X.OBJECTS} SELECT image, count(*) FILTER (WHERE subtype = 'A') AS "A", count(*) FILTER (WHERE subtype = 'N') AS "N", count(*) FILTER (WHERE subtype = 'R') AS "R" FROM objects GROUP BY image"""
)
def size_table(spark, d):
    return A.composition(X.objects(spark, d), ["image"], "subtype", ["A", "N", "R"], share=False)


@query(
    f"WITH {X.TRACKS} SELECT cell, label, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS frames_present, count(DISTINCT frame) * 10 AS duration FROM tracks GROUP BY 1, 2"
)
def lifetimes(spark, d):
    return A.lifetimes(X.tracks(spark, d), ["cell", "label"], "frame")


@query(
    f"WITH {X.TRACKS} SELECT cell, label, min(frame) AS start, max(frame) AS stop, max(frame) - min(frame) + 1 AS span FROM tracks GROUP BY 1, 2"
)
def lifetime_intervals(spark, d):
    lives = A.lifetimes(X.tracks(spark, d), ["cell", "label"], "frame")
    return lives.select("cell", "label", F.col("first_frame").alias("start"), F.col("last_frame").alias("stop"), (F.col("last_frame") - F.col("first_frame") + 1).alias("span"))


@query(
    f"""WITH {X.TRACKS}, l AS (SELECT cell, label, min(frame) AS f FROM tracks GROUP BY 1, 2), c AS (SELECT DISTINCT cell FROM tracks), t AS (SELECT DISTINCT frame FROM tracks)
    SELECT c.cell, t.frame, count(l.label) AS new, round(count(l.label) / 10, 6) AS rate FROM c CROSS JOIN t LEFT JOIN l ON l.cell = c.cell AND l.f = t.frame GROUP BY 1, 2"""
)
def new_per_frame(spark, d):
    tracks = X.tracks(spark, d)
    return rounded(A.new_by_frame(A.lifetimes(tracks, ["cell", "label"], "frame"), "cell", tracks, "frame"))


@query(
    f"""WITH {X.TRACKS} SELECT c.c_custkey AS cell, round(coalesce(quantile_cont(value, 0.75), 0), 9) AS q75, round(coalesce(avg(value), 0), 9) AS mean, round(coalesce(stddev_pop(value), 0), 9) AS std, count(value) AS n
    FROM customer c LEFT JOIN tracks t ON t.cell = c.c_custkey GROUP BY 1"""
)
def list_summary(spark, d):
    people = S.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    return rounded(A.list_summary(people.join(X.tracks(spark, d).select("cell", "value"), "cell", "left"), ["cell"], "value"), 9)


@query(
    f"""WITH {X.TRACKS}, b AS (SELECT cell, nullif(coalesce(avg(value) FILTER (WHERE frame = 0), arg_min(value, (frame, value))), 0) AS s FROM tracks GROUP BY cell),
    c AS (SELECT frame, (value - s) / s * 100 AS change FROM tracks JOIN b USING (cell))
    SELECT frame, count(change) AS n, round(avg(change), 4) AS mean, round(stddev_samp(change) / sqrt(count(change)), 4) AS sem, round(stddev_samp(change), 4) AS std, round(min(change), 4) AS least, round(max(change), 4) AS most
    FROM c GROUP BY frame"""
)
def pct_change_from_baseline(spark, d):
    return rounded(A.change_from_baseline(X.tracks(spark, d), "cell", "frame", "value"), 4)


@query(f"WITH {X.TRACKS} SELECT frame, round(avg(value), 6) AS mean, round(avg(value) / (SELECT avg(value) FROM tracks WHERE frame = 0), 6) AS relative FROM tracks GROUP BY frame")
def normalised_to_t0(spark, d):
    return rounded(A.normalised_to_start(X.tracks(spark, d), "frame", "value"))


@query(
    f"""WITH {X.TRACKS}, k AS (SELECT cell FROM tracks GROUP BY cell HAVING count(DISTINCT frame) = (SELECT count(DISTINCT frame) FROM tracks))
    SELECT frame, count(*) AS n, round(avg(value), 6) AS mean FROM tracks WHERE cell IN (SELECT cell FROM k) GROUP BY frame"""
)
def complete_tracks(spark, d):
    whole = A.complete_tracks(X.tracks(spark, d), "cell", "frame")
    return rounded(whole.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query(
    f"""WITH {X.TRACKS}, w AS (SELECT line, avg(value) FILTER (WHERE frame = 0) AS s, avg(value) FILTER (WHERE frame = 4) AS e FROM tracks GROUP BY line)
    SELECT line, round(s, 6) AS start, round(e, 6) AS stop, round(e - s, 6) AS change, round((e - s) * 100 / s, 6) AS percent, round((e - s) / 4, 6) AS rate FROM w"""
)
def wide_delta(spark, d):
    return rounded(A.difference_between(X.tracks(spark, d), "line", "frame", "value", 0, 4))


@query(f"WITH {X.TRACKS} SELECT frame, count(*) AS n, count(*) FILTER (WHERE value > 50) AS positive, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS share FROM tracks GROUP BY frame")
def positives_per_frame(spark, d):
    return rounded(A.positives(X.tracks(spark, d), "frame", F.col("value") > 50))


@query(
    f"""WITH {X.TRACKS}, t AS (SELECT cell, frame, avg(value) AS v FROM tracks GROUP BY 1, 2), g AS (SELECT cell, coalesce(abs(v - lag(v) OVER (PARTITION BY cell ORDER BY frame)), 0) AS step FROM t)
    SELECT cell, round(avg(step), 6) AS speed FROM g GROUP BY cell"""
)
def frame_lag_change(spark, d):
    means = X.tracks(spark, d).groupBy("cell", "frame").agg(F.avg("value").alias("v"))
    step = F.coalesce(F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("cell").orderBy("frame"))), F.lit(0.0))
    return rounded(means.withColumn("step", step).groupBy("cell").agg(F.avg("step").alias("speed")))


@query(
    f"""WITH {X.OBJECTS}, a AS (SELECT DISTINCT price FROM objects), g AS (SELECT price, lead(price) OVER (ORDER BY price) - price AS gap FROM a)
    SELECT round(price, 4) AS price, round(gap, 4) AS gap, row_number() OVER (ORDER BY round(gap, 4) DESC, price) AS place FROM g WHERE gap IS NOT NULL QUALIFY place <= 5"""
)
def largest_gaps(spark, d):
    # gaps within ranges of values, and between the ends of the ranges
    values = X.objects(spark, d).select("price").distinct().withColumn("part", F.floor(F.col("price") / 1000))
    ends = values.groupBy("part").agg(F.min("price").alias("lo"))
    following = ends.select(F.col("part"), F.lead("lo").over(Window.orderBy("part")).alias("after"))
    inner = F.lead("price").over(Window.partitionBy("part").orderBy("price"))
    gaps = values.withColumn("next", inner).join(following, "part").select("price", (F.coalesce("next", "after") - F.col("price")).alias("gap")).where("gap is not null")
    top = rounded(gaps, 4).orderBy(F.col("gap").desc(), "price").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("gap").desc(), "price")))


@query(
    f"""WITH {X.OBJECTS}, r AS (SELECT subtype, order_id, image, price, row_number() OVER (PARTITION BY subtype ORDER BY price DESC, order_id) AS n FROM objects)
    SELECT subtype, list(order_id ORDER BY n) AS ids FROM r WHERE n <= 10 GROUP BY subtype"""
)
def ranked_representatives(spark, d):
    return A.ranked_ids(X.objects(spark, d), "subtype", "order_id", "price", 10)


@query(
    f"""WITH {X.OBJECTS}, h AS (SELECT CAST(least(floor((quantity - 0) / 5.0), 9) AS INTEGER) AS bin, count(*) AS n FROM objects WHERE quantity BETWEEN 0 AND 50 GROUP BY 1)
    SELECT bin, n, round(n / sum(n) OVER () / 5.0, 6) AS density, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cdf FROM h"""
)
def histogram_cdf(spark, d):
    return rounded(A.histogram(X.objects(spark, d), "quantity", 0.0, 50.0, 10))


@query(
    f"""WITH {X.OBJECTS}, a AS (SELECT quantity AS v, sum(count(*)) OVER (ORDER BY quantity) / sum(count(*)) OVER () AS cdf FROM objects WHERE condition = 'O' GROUP BY quantity),
    r AS (SELECT quantity AS v, sum(count(*)) OVER (ORDER BY quantity) / sum(count(*)) OVER () AS cdf FROM objects WHERE condition = 'F' GROUP BY quantity),
    s AS (SELECT cdf, v, lag(cdf) OVER (ORDER BY cdf) AS c0, lag(v) OVER (ORDER BY cdf) AS v0 FROM r),
    m AS (SELECT a.v, (SELECT min(s.cdf) FROM s WHERE s.cdf >= a.cdf) AS at, a.cdf FROM a)
    SELECT m.v AS quantity, round(CASE WHEN s.c0 IS NULL THEN s.v ELSE s.v0 + (s.v - s.v0) * (m.cdf - s.c0) / (s.cdf - s.c0) END, 6) AS matched FROM m JOIN s ON s.cdf = m.at"""
)
def histogram_match(spark, d):
    table = X.objects(spark, d).select("quantity", "condition")
    moved = scale.matched_to(table.where("condition = 'O'"), "quantity", table.where("condition = 'F'"), "quantity", "matched")
    return rounded(moved.select("quantity", "matched").distinct())


_Z = "round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS {c}"


@query(f"WITH {X.OBJECTS} SELECT order_id, image, {_Z.format(c='quantity')}, {_Z.format(c='price')}, 0.0 AS same FROM objects")
def zscore(spark, d):
    table = X.objects(spark, d).select("order_id", "image", "quantity", "price", F.lit(3.0).alias("same"))
    return rounded(scale.z_scored(table, ["quantity", "price", "same"]))


@query(
    f"""WITH {X.OBJECTS}, f AS (SELECT avg(quantity) AS qm, stddev_pop(quantity) AS qs, avg(tax) AS tm, stddev_pop(tax) AS ts FROM objects WHERE condition = 'F')
    SELECT order_id, image, round((quantity - qm) / qs, 6) AS quantity, round((tax - tm) / ts, 6) AS tax FROM objects, f WHERE condition = 'O'"""
)
def zscore_fit_apply(spark, d):
    table = X.objects(spark, d)
    scaler = scale.fit_scaler(table.where("condition = 'F'"), ["quantity", "tax"])
    return rounded(scale.apply_scaler(table.where("condition = 'O'").select("order_id", "image", "quantity", "tax"), scaler, ["quantity", "tax"]))


@query(f"WITH {X.OBJECTS} SELECT order_id, image, round(quantity / sqrt(2), 6) AS quantity, round(price / sqrt(2) * 0.5, 6) AS price, tax FROM objects")
def block_normalise(spark, d):
    table = X.objects(spark, d).select("order_id", "image", "quantity", "price", "tax")
    return rounded(scale.weighted(scale.block_normalised(table, [["quantity", "price"], ["tax"]]), {"price": 0.5}))


_CLR = f"""WITH {X.OBJECTS}, p AS (SELECT cell, condition, count(*) FILTER (WHERE subtype = 'A') / count(*) AS a, count(*) FILTER (WHERE subtype = 'N') / count(*) AS n,
    count(*) FILTER (WHERE subtype = 'R') / count(*) AS r FROM objects GROUP BY ALL),
    l AS (SELECT cell, condition, ln(greatest(a, 1e-9)) AS a, ln(greatest(n, 1e-9)) AS n, ln(greatest(r, 1e-9)) AS r FROM p)"""


@query(_CLR + ' SELECT cell, condition, round(a - (a + n + r) / 3, 6) AS "A", round(n - (a + n + r) / 3, 6) AS "N", round(r - (a + n + r) / 3, 6) AS "R" FROM l')
def clr_composition(spark, d):
    names = ["A", "N", "R"]
    shares = A.composition(X.objects(spark, d), ["cell", "condition"], "subtype", names)
    return rounded(shares.select("cell", "condition", *[c.alias(n) for n, c in C.centred_log_ratio(names).items()]))


@query(f"WITH {X.OBJECTS} SELECT order_id, image, price, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS scaled FROM objects")
def minmax(spark, d):
    return rounded(scale.unit_range(X.objects(spark, d).select("order_id", "image", "price"), "price", "scaled"))


@query(
    f"""WITH {X.OBJECTS}, b AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM objects)
    SELECT order_id, image, price, CAST(floor(greatest(least((price - lo) / (hi - lo), 1), 0) * 255) AS INTEGER) AS byte FROM objects, b"""
)
def percentile_uint8(spark, d):
    return scale.to_byte(X.objects(spark, d).select("order_id", "image", "price"), "price", "byte")


@query(
    f"""WITH {X.OBJECTS}, m AS (SELECT feature, f, o FROM (SELECT 'quantity' AS feature, var_samp(quantity) FILTER (WHERE condition = 'F') AS f, var_samp(quantity) FILTER (WHERE condition = 'O') AS o FROM objects
    UNION ALL SELECT 'price', var_samp(price) FILTER (WHERE condition = 'F'), var_samp(price) FILTER (WHERE condition = 'O') FROM objects))
    SELECT feature, round(f, 2) AS control, round(o, 2) AS treated, round(o - f, 2) AS change, CASE WHEN o > f THEN 'increase' WHEN o < f THEN 'decrease' ELSE 'same' END AS direction FROM m"""
)
def variance_change(spark, d):
    return rounded(A.variance_change(X.objects(spark, d), "condition", "F", "O", ["quantity", "price"]), 2)


@query(
    f"""WITH {X.OBJECTS} SELECT 'quantity' AS feature, round(avg(quantity), 6) AS mean, round(stddev_pop(quantity), 6) AS std FROM objects
    UNION ALL SELECT 'tax', round(avg(tax), 6), round(stddev_pop(tax), 6) FROM objects"""
)
def dataset_metrics(spark, d):
    return rounded(A.population_metrics(X.objects(spark, d), ["quantity", "tax"]))


@query("SELECT avg(CAST(c_name IS NULL AS INTEGER)) AS c_name, round(avg(CAST(nullif(c_mktsegment, 'BUILDING') IS NULL AS INTEGER)), 6) AS c_mktsegment FROM customer")
def null_shares(spark, d):
    return rounded(schema.null_shares(S.table(spark, d, "customer").select("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    return rounded(W.tumbling(S.table(spark, d, "events"), "ts", "10 minutes", ["event_type"], "value"), 4)


@query(
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL '10 minutes', ts), time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '10 minutes', time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '20 minutes']) AS window_start, event_type, value FROM events)
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"""
)
def sliding(spark, d):
    return rounded(W.sliding(S.table(spark, d, "events"), "ts", "30 minutes", "10 minutes", ["event_type"], "value"), 4)


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS first FROM events),
    s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""
)
def session_windows(spark, d):
    return rounded(W.sessions(S.table(spark, d, "events"), "ts", "30 minutes", ["user_id"], "value"), 4)
