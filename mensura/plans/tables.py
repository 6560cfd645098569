"""Queries of loading, shaping, cleaning and joining."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import columns as C
from mensura.operators import clean, joins, reshape, schema
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


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey "
    "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
)
def measurement_attach_cell(spark, d):
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    people = S.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    lines = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.join(orders, "l_orderkey", "left").join(people, "o_custkey", "left").join(nations, "c_nationkey", "left").drop("c_nationkey")


@query(
    r"""SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) AS part,
    TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS number,
    CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'anchor' ELSE 'plain' END AS query FROM pages"""
)
def path_table_parse(spark, d):
    return S.table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in S.path_parts(F.col("url")).items()])


@query(
    r"""SELECT keyword, max_by(url, page_id) AS path FROM (SELECT regexp_extract(url, '/(en|de|fr|es)/', 1) AS keyword, url, page_id FROM pages)
    WHERE keyword <> '' GROUP BY keyword"""
)
def path_dictionary(spark, d):
    return S.last_path(S.table(spark, d, "pages"), "url", F.regexp_extract("url", "/(en|de|fr|es)/", 1), "page_id")


@query(
    """WITH parts AS (
      SELECT 0 AS pos, o_custkey AS k, max(o_totalprice) AS price, nullif(min(o_orderpriority), '1-URGENT') AS priority FROM orders WHERE o_orderstatus = 'F' GROUP BY k
      UNION ALL SELECT 1, o_custkey, max(o_totalprice), min(o_orderpriority) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey
      UNION ALL SELECT 2, o_custkey, max(o_totalprice), min(o_orderpriority) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
    SELECT k, arg_min(price, pos) FILTER (WHERE price IS NOT NULL) AS price, arg_min(priority, pos) FILTER (WHERE priority IS NOT NULL) AS priority FROM parts GROUP BY k"""
)
def first_non_null_merge(spark, d):
    orders = S.table(spark, d, "orders")

    def part(status, first):
        least = F.min("o_orderpriority")
        kept = F.nullif(least, F.lit("1-URGENT")) if first else least
        return orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), kept.alias("priority"))

    return S.first_known([part("F", True), part("O", False), part("P", False)], ["k"])


@query(
    """SELECT l_suppkey AS cell, l_linenumber AS image, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) - 1 AS layer,
    row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS number,
    concat_ws('_', l_suppkey, layer, number) AS object_id, substring_index FROM (SELECT *, CAST(l_suppkey AS VARCHAR) AS substring_index FROM lineitem)"""
)
def object_id_layers(spark, d):
    lines = S.table(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "cell", "l_linenumber": "image"})
    made = S.layers(lines, "cell", "image", ["l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    return made.select("cell", "image", "layer", "number", "object_id", F.substring_index("object_id", "_", 1).alias("substring_index"))


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    WHERE rank <= 3"""
)
def top_k_per_group(spark, d):
    orders = S.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reshape.top_of_group(orders, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    round(l_quantity / (l_quantity + l_discount + l_tax), 9) AS quantity_share, round((l_quantity + l_discount + l_tax) / 3, 9) AS mean_measure,
    round(l_extendedprice / nullif(l_quantity, 0), 9) AS unit_price, round(4 * pi() * l_extendedprice / (l_quantity * l_quantity), 9) AS circularity,
    round(l_extendedprice * 0.481 * 0.481, 9) AS area_um, round(sqrt((l_quantity - l_discount) * (l_quantity - l_discount) + (l_tax - 1) * (l_tax - 1)), 9) AS distance FROM lineitem"""
)
def derived_measures(spark, d):
    q, c, t, p = (F.col(f"l_{n}") for n in ("quantity", "discount", "tax", "extendedprice"))
    return (
        S.table(spark, d, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            F.round(C.share_of_row(["l_quantity", "l_discount", "l_tax"])["l_quantity"], 9).alias("quantity_share"), F.round(C.row_mean(["l_quantity", "l_discount", "l_tax"]), 9).alias("mean_measure"),
            F.round(C.ratio(p, q), 9).alias("unit_price"), F.round(C.circularity(p, q), 9).alias("circularity"), F.round(p * 0.481 * 0.481, 9).alias("area_um"), F.round(C.distance(q, t, c, F.lit(1.0)), 9).alias("distance"),
        )
    )


@query(
    """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'alloy' WHEN contains(lower(p_type), 'tin') THEN 'soft' ELSE 'other' END AS family,
    split_part(p_type, ' ', 1) AS kind FROM part"""
)
def keyword_groups(spark, d):
    family = C.first_keyword(F.col("p_type"), {"steel": "metal", "brass": "alloy", "tin": "soft"}, "other")
    return S.table(spark, d, "part").select("p_partkey", family.alias("family"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))


@query(
    """SELECT p_brand, count(*) FILTER (WHERE contains(lower(p_type), 'steel')) AS steel, count(*) FILTER (WHERE contains(lower(p_type), 'brass')) AS brass,
    count(*) FILTER (WHERE contains(lower(p_type), 'copper')) AS copper FROM part GROUP BY p_brand"""
)
def keyword_cross_table(spark, d):
    counts = [F.count(F.when(F.lower("p_type").contains(k), 1)).alias(k) for k in ("steel", "brass", "copper")]
    return S.table(spark, d, "part").groupBy("p_brand").agg(*counts)


@query(
    "SELECT c_custkey, c_acctbal FROM customer"
)
def drop_empty_and_constant(spark, d):
    people = S.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.nullif("c_nationkey", "c_nationkey").alias("c_empty"), F.lit(1.5).alias("c_same"))
    held, _ = schema.without_empty(people)
    return schema.without_constant(held, ("c_custkey",))[0]


@query("SELECT c_custkey AS cell, c_acctbal AS cell_acctbal, c_nationkey AS cell_nationkey, 0.0 AS extra FROM customer")
def keyword_rename_and_align(spark, d):
    people = schema.listed(S.table(spark, d, "customer"), ["c_custkey", "missing", "c_acctbal", "c_nationkey"])
    named = schema.renamed(people, {"c_custkey": "cell", "c_": "cell_"})
    like = named.limit(0).withColumn("extra", F.lit(0.0))
    return schema.aligned(named, like).select("cell", *schema.with_keywords(named.columns, ["_acct", "_nation"]), "extra")


@query(
    f"""WITH {X.OBJECTS}, b1 AS (SELECT quantile_cont(quantity, 0.05) AS lo, quantile_cont(quantity, 0.95) AS hi FROM objects),
    s1 AS (SELECT o.* FROM objects o, b1 WHERE quantity BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)),
    b2 AS (SELECT quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM s1)
    SELECT cell, count(*) AS n, round(sum(s1.price), 2) AS price FROM s1, b2 GROUP BY cell"""
)
def outliers_sequential(spark, d):
    left, _ = clean.within_wide_bounds(X.objects(spark, d), ["quantity", "discount", "tax"])
    return rounded(left.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price")), 2)


@query(
    f"""WITH {X.TRACKS}, b AS (SELECT line, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM tracks GROUP BY line)
    SELECT t.line, t.cell, t.frame, round(t.value, 6) AS value FROM tracks t JOIN b USING (line) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
)
def outliers_iqr_grouped(spark, d):
    return rounded(clean.within_group_quartiles(X.tracks(spark, d), "line", "value").select("line", "cell", "frame", "value"))


@query(
    f"""WITH {X.OBJECTS}, b AS (SELECT image, quantile_cont(price, 0.9) * 0.5 AS cut FROM objects GROUP BY image)
    SELECT image, count(*) AS n, round(max(price), 4) AS most FROM objects JOIN b USING (image) WHERE price <= cut GROUP BY image"""
)
def dynamic_percentile_cut(spark, d):
    left = clean.under_percentile_cut(X.objects(spark, d), "image", "price", 0.9, 0.5)
    return rounded(left.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("most")), 4)


@query(
    f"""WITH {X.TRACKS}, t AS (SELECT *, CASE frame % 3 WHEN 0 THEN CAST(frame AS VARCHAR) WHEN 1 THEN frame || '.0' ELSE 't' || frame END AS tp FROM tracks)
    SELECT tp, count(*) AS n FROM t WHERE TRY_CAST(tp AS DOUBLE) IN (0, 1, 4) GROUP BY tp"""
)
def numeric_timepoint_match(spark, d):
    f = F.col("frame")
    tp = F.when(f % 3 == 0, f.cast("string")).when(f % 3 == 1, F.concat(f.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("t"), f.cast("string")))
    named = X.tracks(spark, d).withColumn("tp", tp)
    return named.where(clean.at_time("tp", 0) | clean.at_time("tp", 1) | clean.at_time("tp", 4)).groupBy("tp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_members(spark, d):
    members = S.table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, d, "customer").select("c_custkey", "c_name").join(members, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_removed(spark, d):
    orders = S.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return clean.removed(S.table(spark, d, "customer"), orders, ["c_custkey"])


@query(
    """SELECT cell, round(o.price, 2) AS orders_price, o.n AS orders_n, c.balance AS people_balance, e.n AS events_n FROM
    (SELECT o_custkey AS cell, sum(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT c_custkey AS cell, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) c USING (cell)
    FULL JOIN (SELECT user_id AS cell, count(*) AS n FROM events GROUP BY 1) e USING (cell)"""
)
def outer_fold_sheets(spark, d):
    sheets = {
        "orders": S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.sum("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n")),
        "people": S.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("balance")),
        "events": S.table(spark, d, "events").groupBy(F.col("user_id").alias("cell")).agg(F.count(F.lit(1)).alias("n")),
    }
    return rounded(joins.outer_fold(sheets, "cell"), 2)


@query(
    """SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1)
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) USING (nation)"""
)
def dynamic_key_outer_join(spark, d):
    people = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    firms = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return joins.outer_on_common(people, firms)


@query("SELECT c_custkey AS id, coalesce(s_acctbal, c_acctbal) AS balance, c_name AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def coalesce_update(spark, d):
    people = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return joins.updated(people, S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), "id")


@query(
    """SELECT o.o_orderkey, n.nation, n.balance FROM orders o LEFT JOIN
    (SELECT c_custkey, arg_max(c_nationkey, k) AS nation, arg_max(c_acctbal, k) AS balance FROM (SELECT c_custkey % 100 AS c_custkey, c_custkey AS k, c_nationkey, c_acctbal FROM customer) GROUP BY 1) n
    ON o.o_custkey % 100 = n.c_custkey"""
)
def dimension_last_wins(spark, d):
    dim = S.table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("key"), F.col("c_custkey").alias("at"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    orders = S.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("key"))
    return joins.looked_up(orders, dim, "key", ["at"]).select("o_orderkey", "nation", "balance")


@query(
    """WITH i AS (SELECT p_partkey AS id, p_brand AS brand, CAST(floor(p_retailprice) AS BIGINT) AS start, CAST(floor(p_retailprice) + p_size AS BIGINT) AS stop FROM part)
    SELECT a.id AS a, b.id AS b, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared FROM i a JOIN i b ON a.brand = b.brand AND a.id < b.id AND a.start < b.stop AND b.start < a.stop"""
)
def bbox_overlap_join(spark, d):
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.floor("p_retailprice").alias("start"), (F.floor("p_retailprice") + F.col("p_size")).alias("stop"))
    return joins.overlapping_within(part, 50, ["brand"]).select("a", "b", "shared")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def drop_duplicate_cells(spark, d):
    return clean.first_of_duplicates(S.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS feature, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def explode_list(spark, d):
    return rounded(S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "v")).select("vec_id", "feature", F.col("v").cast("double").alias("value")))


@query(
    f"""WITH {X.TRACKS}, m AS (SELECT cell, frame AS key, round(sum(value), 4) AS value FROM tracks GROUP BY 1, 2) SELECT cell, key, value FROM m"""
)
def explode_map(spark, d):
    daily = X.tracks(spark, d).groupBy("cell", "frame").agg(F.sum("value").alias("v"))
    packed = daily.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("frame", "v"))).alias("m"))
    return rounded(reshape.exploded_map(packed, ["cell"], F.col("m")), 4)


@query(f"WITH {X.FEATURES} SELECT feature, subtype, count(*) AS n, round(avg(value), 6) AS mean FROM features GROUP BY 1, 2")
def melt_features(spark, d):
    return rounded(X.features(spark, d).groupBy("feature", "subtype").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query(
    """SELECT treatment, id, balance, name FROM (SELECT 'customer' AS treatment, c_custkey AS id, c_acctbal AS balance, c_name AS name FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier)"""
)
def union_tagged(spark, d):
    people = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    firms = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return reshape.tagged_union({"customer": people, "supplier": firms}, "treatment").select("treatment", "id", "balance", "name")


@query("SELECT DISTINCT a.event_type AS group1, b.event_type AS group2 FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_type < b.event_type")
def upper_triangle_pairs(spark, d):
    return reshape.group_pairs(S.table(spark, d, "events"), "event_type")


@query(
    f"WITH {X.OBJECTS} SELECT cell, round(avg(quantity) FILTER (WHERE subtype = 'A'), 6) AS \"A\", round(avg(quantity) FILTER (WHERE subtype = 'N'), 6) AS \"N\", round(avg(quantity) FILTER (WHERE subtype = 'R'), 6) AS \"R\" FROM objects GROUP BY cell"
)
def pivot_means(spark, d):
    return rounded(reshape.wide_form(X.objects(spark, d), ["cell"], "subtype", ["A", "N", "R"], "quantity"))


@query("SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_number, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT), p_partkey) AS place FROM part QUALIFY place <= 100")
def natural_order(spark, d):
    part = S.table(spark, d, "part").select("p_partkey", reshape.natural_key(F.col("p_brand")).alias("brand_number"))
    first = part.orderBy("brand_number", "p_partkey").limit(100)
    from pyspark.sql import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy("brand_number", "p_partkey")))
