"""Operators on small hand-made frames: ties, constants, nulls, empty groups, known values."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mensura.functions import columns as C
from mensura.functions import special
from mensura.operators import aggregate, clean, cluster, components, joins, models, reshape, scale, schema, spatial, stats, tiles, tracking, voxels, zones
from mensura.operators.quantiles import quantiles, with_quantiles
from mensura.operators.running import part_of, running_sum
from mensura.sources import tables
from mensura.streaming import windows


@settings(max_examples=60, deadline=None)
@given(st.floats(0.1, 60), st.floats(0.1, 60), st.floats(0.01, 0.99))
def test_beta_reflects_and_gamma_recurs(a, b, x):
    assert special.incomplete_beta(a, b, x) + special.incomplete_beta(b, a, 1 - x) == pytest.approx(1, abs=1e-10)
    y = 80 * x
    step = math.exp(a * math.log(y) - y - math.lgamma(a + 1))
    assert special.upper_gamma(a + 1, y) == pytest.approx(special.upper_gamma(a, y) + step, abs=1e-10)


def test_studentised_range():
    assert special.studentised_range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)
    assert special.studentised_range_tail(2.2281388519 * math.sqrt(2), 2, 10) == pytest.approx(0.05, abs=1e-3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=12))
def test_enclosing_circle(points):
    p = np.array(points, float)
    x, y, r = spatial.enclosing_circle(p)
    assert all(math.dist((x, y), q) <= r + 1e-7 for q in points)
    # no smaller circle: one through two or three points that covers all
    best = 0.0 if len(set(points)) == 1 else min(
        c[2] for c in _circles(sorted(set(points))) if all(math.dist(c[:2], q) <= c[2] + 1e-7 for q in points)
    )
    assert r == pytest.approx(best, abs=1e-6)


def _circles(points):
    for a, b in itertools.combinations(points, 2):
        yield (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b) / 2
    for a, b, c in itertools.combinations(points, 3):
        m = 2 * np.array([[b[0] - a[0], b[1] - a[1]], [c[0] - a[0], c[1] - a[1]]], float)
        if abs(np.linalg.det(m)) > 1e-9:
            x, y = np.linalg.solve(m, [b[0] ** 2 + b[1] ** 2 - a[0] ** 2 - a[1] ** 2, c[0] ** 2 + c[1] ** 2 - a[0] ** 2 - a[1] ** 2])
            yield x, y, math.dist((x, y), a)


def test_known_tails():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.chi2_tail(2 * 3.0, 2) == pytest.approx(math.exp(-3.0), abs=1e-12)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert special.f_tail(4.0, 2, 2) == pytest.approx(1 / 5, abs=1e-12)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert special.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70, abs=1e-9)
    assert special.fisher_two_sided(0, 0, 3, 4) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(7)
    rows = [("f", g, float(rng.randrange(6) + s)) for g, s, n in (("a", 0, 12), ("b", 1, 9), ("c", 2, 15)) for _ in range(n)]
    rows += [("flat", g, 1.0) for g in "abc" for _ in range(3)] + [("f", "a", None)]
    return spark.createDataFrame(rows, "feature string, grp string, value double")


def values(long, group):
    return [r.value for r in long.where((F.col("feature") == "f") & (F.col("grp") == group) & F.col("value").isNotNull()).collect()]


def test_rank_tests(long):
    groups = {g: values(long, g) for g in "abc"}
    pooled = sorted(itertools.chain(*groups.values()))
    rank = {v: np.mean([i + 1 for i, x in enumerate(pooled) if x == v]) for v in set(pooled)}
    n = len(pooled)
    tie = sum(c**3 - c for c in (pooled.count(v) for v in set(pooled)))
    h = (12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups.values()) - 3 * (n + 1)) / (1 - tie / (n**3 - n))
    found = {r.feature: r for r in stats.kruskal(long, "grp").collect()}
    assert found["f"].h == pytest.approx(h) and found["f"].p == pytest.approx(math.exp(-h / 2)) and found["flat"].h is None
    for r in stats.cliffs_delta_pairs(long, "grp").where("feature = 'f'").collect():
        x, y = groups[r.group1], groups[r.group2]
        assert r.delta == pytest.approx(np.mean([np.sign(a - b) for a in x for b in y]))
    for r in stats.dunn(long, "grp").where("feature = 'f'").collect():
        x, y = groups[r.group1], groups[r.group2]
        spread = (n * (n + 1) / 12 - tie / (12 * (n - 1))) * (1 / len(x) + 1 / len(y))
        assert r.z == pytest.approx((np.mean([rank[v] for v in x]) - np.mean([rank[v] for v in y])) / math.sqrt(spread))


def test_mann_whitney_of_separated_groups(spark):
    rows = [("s", "F", float(k)) for k in range(5)] + [("s", "O", float(k + 10)) for k in range(7)]
    r = stats.mann_whitney(spark.createDataFrame(rows, "by string, side string, value double"), "side", "F", "O", ["by"]).first()
    assert (r.u, r.delta) == (0.0, -1.0) and 0 < r.p < 0.01


def test_dunn_categories(spark):
    pairs = spark.createDataFrame([("f", "a", "b", 0.01), ("f", "a", "c", 0.01), ("f", "b", "c", 0.5), ("g", "a", "b", 0.5), ("g", "a", "c", 0.5), ("g", "b", "c", 0.5)], "feature string, group1 string, group2 string, p_adj double")
    kinds = {(r.feature, r.group): r.category for r in stats.partners(pairs, 0.05).collect()}
    assert kinds[("f", "a")] == "differs_from_both" and kinds[("f", "b")] == "differs_from_exactly_one" and kinds[("g", "a")] == "differs_from_none"
    assert {r.feature: r.topology for r in stats.topology(pairs, 0.05).collect()} == {"f": "one_differ_from_all", "g": "only_pairwise"}
    assert {r.feature: r.extent for r in stats.all_or_none(pairs, 0.05).collect()} == {"f": "partial", "g": "none"}


def test_adjusted_probabilities(spark):
    ps = [0.01, 0.04, 0.03, None, 0.2]
    frame = spark.createDataFrame(list(enumerate(ps)), "id int, p double")
    got = {how: {r.id: r.p_adj for r in stats.adjusted(frame, how=how).collect()} for how in ("fdr_bh", "holm", "bonferroni", "fdr_by")}
    assert got["fdr_bh"] == pytest.approx({0: 0.04, 1: 0.16 / 3, 2: 0.16 / 3, 4: 0.2, 3: None})
    assert got["holm"] == pytest.approx({0: 0.04, 1: 0.09, 2: 0.09, 4: 0.2, 3: None})
    assert got["bonferroni"] == pytest.approx({0: 0.04, 1: 0.16, 2: 0.12, 4: 0.8, 3: None})
    assert got["fdr_by"][0] == pytest.approx(0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4))


def test_summaries_scaling_and_nulls(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", None, 2.0), ("b", 4.0, 2.0), (None, 9.0, 2.0)]
    frame = spark.createDataFrame(rows, "g string, x double, k double")
    got = {r.g: r for r in aggregate.summarised(frame, "g", ["x", "k"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].x_mean == 1.5 and "k_median" not in got["a"].asDict() and got["b"].x_std is None
    scaled = scale.z_scored(frame, ["x", "k"])
    assert {r.k for r in scaled.collect()} == {0.0} and scaled.where("g = 'a' and x = 0").count() == 1
    assert schema.without_empty(frame.withColumn("e", F.lit(None).cast("double")))[1] == ["e"]
    assert schema.without_constant(frame, ("g",))[1] == ["k"]
    left, culprits = clean.within_wide_bounds(spark.createDataFrame([(float(v),) for v in [*range(100), 9999]], "x double"), ["x"])
    assert left.count() == 100 and culprits == ["x"]


def test_scaler_is_not_moved_by_what_it_is_applied_to(spark):
    control = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    treated = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert sorted(r.x for r in scale.apply_scaler(treated, scale.fit_scaler(control, ["x"]), ["x"]).collect()) == [0.0, 3.0]


def test_joins(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 20, 25), (3, 5, 5)], "id int, start long, stop long")
    b = spark.createDataFrame([(7, 9, 21), (8, 10, 20)], "id int, start long, stop long")
    pairs = joins.overlapping(a, b, 4)
    assert sorted((r.a.id, r.b.id) for r in pairs.collect()) == [(1, 7), (2, 7)]
    rng = random.Random(4)
    spans = [(i % 90, rng.choice("xy"), s := rng.randrange(-20, 40), s + rng.randrange(0, 9)) for i in range(120)] + [(None, "x", 0, 50), (7, None, 0, 50), *[(900 + i, "y", 3, 9) for i in range(30)]]
    wanted = sorted((p[1], p[0], q[0], min(p[3], q[3]) - max(p[2], q[2])) for p in spans for q in spans if None not in p + q and p[0] < q[0] and p[1] == q[1] and max(p[2], q[2]) < min(p[3], q[3]))
    held = spark.createDataFrame(spans, "id long, g string, start long, stop long")
    for block, most in ((4096, 512), (16, 4)):
        met = joins.overlapping_within(held, 5, ["g"], block=block, most=most)
        assert sorted((r.g, r.a, r.b, r.shared) for r in met.collect()) == wanted
    # a table of few bytes still meets in more than one task
    assert met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    rng = random.Random(5)
    points = [(i, i % 3, rng.random(), rng.random() * (1 if i % 3 else 0.01)) for i in range(60)] + [(99, 9, 0.0, 0.0)]
    frame = spark.createDataFrame(points, "id long, cell long, x double, y double")
    near = {r.a: r.distance for r in joins.nearest(frame, "cell", 0.01).collect()}
    for i, c, x, y in points[:-1]:
        assert near[i] == pytest.approx(min(math.dist((x, y), p[2:]) for p in points if p[1] == c and p[0] != i))
    assert 99 not in near
    found = {(r.a, r.b) for r in joins.within_radius(frame, 0.2).collect()}
    assert found == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and math.dist(p[2:], q[2:]) <= 0.2}


def test_first_known_takes_each_column_from_the_first_part_that_has_it(spark):
    one = spark.createDataFrame([(1, None, "a"), (2, 5.0, None)], "k int, x double, y string")
    two = spark.createDataFrame([(1, 3.0, "b"), (3, 1.0, "c")], "k int, x double, y string")
    assert sorted(tuple(r) for r in tables.first_known([one, two], ["k"]).collect()) == [(1, 3.0, "a"), (2, 5.0, None), (3, 1.0, "c")]


def mask_of(spark, picture, image=0):
    cells = [(image, y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(cells, "image long, y long, x long")


def test_masks(spark):
    ring = mask_of(spark, ["#####", "#...#", "#.#.#", "#...#", "#####"])
    labels = voxels.labelled(ring, 5)
    assert {r.label: r.area for r in voxels.region_props(labels).collect()} == {0: 16, 12: 1}
    assert voxels.filled(ring, 5, 5).count() == 25 and voxels.holes(ring, 5, 5).count() == 8
    diagonal = mask_of(spark, ["#.", ".#"])
    assert voxels.labelled(diagonal, 2, 8).select("label").distinct().count() == 1
    assert voxels.labelled(diagonal, 2, 4).select("label").distinct().count() == 2
    block = mask_of(spark, ["...", "###", "###", "###"])
    assert [(r.y, r.x) for r in voxels.eroded(block).collect()] == [(2, 1)]
    assert voxels.opened(block, 3, 4).count() == 9 and voxels.closed(ring, 5, 5).count() == 25
    assert clean.clear_of_border(labels, ["image", "label"], 5, 5).count() == 1
    far = tiles.deepest(mask_of(spark, [".....", ".###.", ".###.", ".###.", "....."]), 5, 5).first()
    assert (far.depth, far.y, far.x) == (2, 2, 2)


def test_labelling_against_flood_fill(spark):
    rng = random.Random(3)
    picture = ["".join(rng.choice("#..") for _ in range(16)) for _ in range(16)]
    places = {(y, x) for y in range(16) for x in range(16) if picture[y][x] == "#"}
    want = {}
    for start in sorted(places):
        if start not in want:
            todo = [start]
            while todo:
                y, x = todo.pop()
                if (y, x) in places and (y, x) not in want:
                    want[(y, x)] = start[0] * 16 + start[1]
                    todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    assert {(r.y, r.x): r.label for r in voxels.labelled(mask_of(spark, picture), 16).collect()} == want


@pytest.mark.parametrize("last_pairs", [0, 50, 1 << 22])
def test_density_clusters_of_crowds_against_all_pairs(spark, monkeypatch, last_pairs):
    monkeypatch.setattr(components, "LAST_PAIRS", last_pairs)
    draw = random.Random(7)
    at = [(draw.gauss(cx, 0.04), draw.gauss(cy, 0.04)) for cx, cy in ((0, 0), (0.25, 0), (1, 1)) for _ in range(40)]
    at += [(draw.uniform(-1, 2), draw.uniform(-1, 2)) for _ in range(60)] + [(0.5, -0.5)] * 5 + [(None, 0.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    radius = 0.06
    near = {i: [j for j, q in enumerate(at) if None not in p + q and math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) <= radius] for i, p in enumerate(at)}
    for least in (1, 4):
        core = {i for i in near if max(len(near[i]), 1) >= least}
        want, waiting = {}, []
        for i in sorted(core):
            waiting = [] if i in want else [i]
            while waiting:
                k = waiting.pop()
                if k not in want:
                    want[k] = i
                    waiting += [j for j in near[k] if j in core]
        for i in set(near) - core:
            want[i] = min((want[j] for j in near[i] if j in core), default=None)
        got = {r.id: (r.core, r.cluster) for r in components.density_clusters(points, radius, least).collect()}
        assert got == {i: (i in core, want[i]) for i in near}


def test_density_clusters_make_no_pairs_of_a_crowd(spark):
    # a crowd of 60,000 has 1.8 milliard pairs
    points = spark.range(60000).select("id", (F.col("id") % 300 / 1e5).alias("x"), (F.floor(F.col("id") / 300) / 1e5).alias("y"))
    assert components.near_components(points, 0.02).agg(F.max("root"), F.count(F.lit(1))).first() == (0, 60000)


def test_density_clusters(spark):
    xs = [0.0, 0.1, 0.2, 0.3, 5.0, 5.1, 5.2, 9.0]
    frame = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(xs)], "id long, x double, y double")
    got = {r.id: r.cluster for r in components.density_clusters(frame, 0.11, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 5, 5: 5, 6: 5, 7: None}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    pairs = tracking.assignment(cost)
    small, large = sorted((n, m))
    best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
    assert len(pairs) == small and sum(cost[i, j] for i, j in pairs) == best


def test_tracks(spark):
    rows = [(0, 0, 0, 0, 1), (0, 0, 0, 1, 1), (0, 0, 5, 5, 2), (0, 1, 0, 1, 1), (0, 1, 0, 2, 1), (0, 2, 0, 2, 4), (0, 2, 9, 9, 5)]
    frames = spark.createDataFrame(rows, "series long, t long, y long, x long, label long")
    matches = tracking.match_frames(tracking.frame_overlaps(frames))
    tracks = {(r.t, r.label): (r.first_t, r.first_label) for r in tracking.track_ids(frames, matches).collect()}
    assert tracks == {(0, 1): (0, 1), (0, 2): (0, 2), (1, 1): (0, 1), (2, 4): (0, 1), (2, 5): (2, 5)}


def test_ward_against_plain_merging():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(14, 3))
    merges = cluster.ward_merges(points, np.ones(14))
    groups = [[i] for i in range(14)]
    for step in range(13):
        def cost(a, b):
            return 2 * len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(axis=0) - points[b].mean(axis=0)) ** 2).sum()

        a, b = min(itertools.combinations(groups, 2), key=lambda p: cost(*p))
        assert merges[step, 2] == pytest.approx(math.sqrt(cost(a, b)))
        groups = [g for g in groups if g not in (a, b)] + [a + b]
        found = cluster.ward_cut(merges, 14, 13 - step)
        assert {frozenset(np.flatnonzero(found == k)) for k in set(found)} == {frozenset(g) for g in groups}


def test_two_way_anova_of_a_balanced_table(spark):
    rng = np.random.default_rng(0)
    rows = [(f"a{i}", f"b{j}", float(i + 2 * j + rng.normal())) for i in range(3) for j in range(2) for _ in range(5)]
    got = {r.factor: r for r in stats.two_way_anova(spark.createDataFrame(rows, "a string, b string, v double"), "a", "b", "v").collect()}
    v = np.array([r[2] for r in rows]).reshape(3, 2, 5)
    cells, grand = v.mean(axis=2), v.mean()
    squares = {"a": 10 * ((v.mean(axis=(1, 2)) - grand) ** 2).sum(), "b": 15 * ((v.mean(axis=(0, 2)) - grand) ** 2).sum()}
    squares["a:b"] = 5 * ((cells - grand) ** 2).sum() - squares["a"] - squares["b"]
    error = ((v - cells[:, :, None]) ** 2).sum() / 24
    for factor, df in (("a", 2), ("b", 1), ("a:b", 2)):
        assert got[factor].squares == pytest.approx(squares[factor]) and got[factor].f == pytest.approx(squares[factor] / df / error)


def test_hull_and_feret(spark):
    points = [(1, x, y) for x in range(5) for y in range(4)]
    r = spatial.hull_measures(spark.createDataFrame([(c, float(x), float(y)) for c, x, y in points], "cell long, x double, y double"), "cell").first()
    assert (r.area, r.perimeter, r.diameter) == (12.0, 14.0, 5.0)


def test_reshaping(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "id int, v array<double>")
    assert sorted(map(tuple, reshape.exploded(frame, ["id"], F.col("v")).collect()), key=str) == [(1, 1.0), (1, 2.0), (2, None)]
    assert spark.range(1).select(C.display_name(F.lit("mean_area__x")).alias("n")).first().n == "Mean Area X"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)

    def replay(make, name, mode):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    def make(df, late=None):
        return windows.tumbling(df, "ts", "1 day", ["event_type"], "value", late)

    batch = {(r.window_start, r.event_type): r.n for r in make(events).collect()}
    stream = {(r.window_start, r.event_type): r.n for r in replay(lambda s: make(s, "60 days"), "tumbled", "complete").collect()}
    assert stream == batch

    once = replay(lambda s: windows.once_each(s, "ts", ["event_id"], "60 days"), "once", "append")
    assert once.count() == events.select("event_id").distinct().count()

    frames = events.select(F.col("user_id"), F.dayofyear("ts").cast("long").alias("day"))
    spans = replay(lambda s: windows.running_spans(s.select(F.col("user_id"), F.dayofyear("ts").cast("long").alias("day")), "user_id", "day"), "spans", "update")
    last = spans.groupBy("user_id").agg(F.max("n").alias("n"), F.min("first_frame").alias("a"), F.max("last_frame").alias("b"))
    want = frames.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("by", [["g"], []])
def test_running_sum(spark, by):
    from mensura.operators.running import running_sum

    rng = random.Random(4)
    rows = [(g if by else "x", float(v), rng.randrange(5)) for g, n in (("a", 300), ("b", 3), ("c", 1)) for v in rng.sample(range(1000 * "abc".index(g), 1000 * "abc".index(g) + 1000), n)]
    got = {(r.g, r.v): r.s for r in running_sum(spark.createDataFrame(rows, "g string, v double, n long"), by, "v", "n", "s", 8).collect()}
    for g, v, _ in rows:
        assert got[(g, v)] == sum(n for h, w, n in rows if h == g and w <= v)


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    import random

    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    monkeypatch.setattr(joins, "HOT_SHARE", 8)
    draw = random.Random(5)
    pairs = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(40)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(120)]
    root = {n: n for pair in pairs for n in pair}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    edges = spark.createDataFrame(pairs, "a long, b long")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    for limit in (0, 20, 1 << 18):
        labels = components.connected_components(edges, limit).collect()
        least = {}
        for r in labels:
            least[r.label] = min(r.node, least.get(r.label, r.node))
        assert {r.node: least[r.label] for r in labels} == {n: top(n) for n in root if sum(n in p and p[0] != p[1] for p in pairs)}
    assert {r.id: r.root for r in components.least_member(nodes, edges).collect()} == {n: top(n) for n in root}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_distances_keep_their_digits():
    draw = np.random.default_rng(5)
    a = draw.normal(size=(40, 64)) + 1e3
    b = np.concatenate([a[:10], a[:10] + 1e-9 * draw.normal(size=(10, 64)), draw.normal(size=(20, 64)) + 1e3])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(cluster.distances(a, b), want, rtol=1e-9, atol=0)


def test_quantiles_have_the_last_digit_of_sql(spark):
    import duckdb

    draw = random.Random(11)
    rows = [(g, round(draw.uniform(900, 105000), 2)) for g in range(200) for _ in range(draw.randrange(12, 40))]
    got = {r.g: r.q for r in quantiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", {"q": 0.9}).collect()}
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (g BIGINT, v DOUBLE)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert got == dict(connection.execute("SELECT g, quantile_cont(v, 0.9) FROM t GROUP BY g").fetchall())


def test_cheapest_merges_of_close_and_equal_clusters(spark):
    draw = np.random.default_rng(2)
    at = draw.normal(size=(30, 8)) + 1e4
    at = np.concatenate([at, at[:10], at[:10] + 1e-7 * draw.normal(size=(10, 8))])
    weight = draw.integers(1, 4, len(at)).astype(float)
    frame = spark.createDataFrame([(k, at[k].tolist(), float(weight[k])) for k in range(len(at))], "i long, c array<double>, w double")
    cost = 2 * weight[:, None] * weight / (weight[:, None] + weight) * ((at[:, None] - at[None]) ** 2).sum(axis=2)
    np.fill_diagonal(cost, np.inf)
    for block in (7, 100):
        got = {r.i: r for r in cluster._nearest(frame, len(at), block).collect()}
        assert sorted(got) == list(range(len(at)))
        assert all(cost[k, r.j] == cost[k].min() and r.cost == cost[k].min() for k, r in got.items())


def test_silhouettes_compare_each_pair_of_blocks_once(spark, monkeypatch):
    asked, own = spark.sparkContext.accumulator(0), cluster.distances

    def counted(a, b):
        asked.add(len(a) * len(b))
        return own(a, b)

    monkeypatch.setattr(cluster, "distances", counted)
    draw = random.Random(3)
    rows = [(i, i % 3, [draw.random(), draw.random()]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, given long, v array<double>").select("id", "given", array_to_vector("v").alias("features"))
    assert cluster.silhouettes(frame, "given", block=40).count() == 400
    assert 400 * 400 / 2 <= asked.value < 400 * 400 * 0.7


def test_silhouettes_by_blocks(spark):
    rng = np.random.default_rng(3)
    points, labels = rng.integers(0, 3, size=(40, 2)).astype(float), [*rng.integers(0, 3, size=39), 7]
    frame = spark.createDataFrame([(i, int(g), p.tolist()) for i, (g, p) in enumerate(zip(labels, points))], "id int, given int, v array<double>")
    frame = frame.select("id", "given", array_to_vector("v").alias("features"))
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for block in (7, 2048):
        found = {r.id: r.silhouette for r in cluster.silhouettes(frame, "given", block=block).collect()}
        for i, g in enumerate(labels):
            own = [j for j in range(40) if labels[j] == g and j != i]
            a = apart[i, own].mean() if own else None
            b = min(apart[i, [j for j in range(40) if labels[j] == o]].mean() for o in set(labels) - {g})
            assert found[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))
    assert [r.silhouette for r in cluster.silhouettes(frame.where("given = 7"), "given").collect()] == [0.0]
    assert cluster.silhouettes(frame.where("given = 9"), "given").count() == 0


def test_silhouettes_of_many_clusterings_take_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(60, 3)) + 6 * rng.integers(0, 3, size=(60, 1))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, v array<double>").select("id", array_to_vector("v").alias("features")).persist()
    want = [cluster.silhouettes(cluster.kmeans_labels(frame, k), "cluster").agg(F.avg("silhouette")).first()[0] for k in (2, 3, 4)]
    passes, made = [], cluster._block_pairs
    monkeypatch.setattr(cluster, "_block_pairs", lambda *a: passes.append(1) or made(*a))
    rows = cluster.best_k(frame, 4).orderBy("k").collect()
    assert passes == [1] and [r.silhouette for r in rows] == pytest.approx(want) and [r.best for r in rows] == [w == max(want) for w in want]


def test_silhouettes_without_labels(spark):
    """A row without a label has 0 and is in no cluster; labels may be texts."""
    rows = [(1, "a", [0.0]), (2, "a", [1.0]), (3, None, [2.0]), (4, "b", [3.0]), (5, "b", [4.0])]
    frame = spark.createDataFrame(rows, "id int, given string, v array<double>").select("id", "given", array_to_vector("v").alias("features"))
    for block in (2, None):
        found = {r.id: (r.given, r.silhouette) for r in cluster.silhouettes(frame, "given", block=block).collect()}
        assert found[3] == (None, 0.0) and found[1] == ("a", pytest.approx(2.5 / 3.5)) and found[4] == ("b", pytest.approx(1.5 / 2.5))


def test_linkage_and_cuts(spark):
    frame = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.0, 1.0, 10.0, 11.5, 30.0])], "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    merges = cluster.linkage(frame)
    rows = merges.orderBy("step").collect()
    assert [(r.a, r.b, r.size) for r in rows] == [(0, 1, 2), (2, 3, 2), (5, 6, 4), (4, 7, 5)]
    assert [r.height for r in rows[:2]] == [1.0, 1.5]
    heights = [r.height for r in rows]
    first, second = cluster.suggested_cut(merges).first(), cluster.suggested_cut(merges, 2).first()
    gaps = np.diff(heights)
    assert first.threshold == pytest.approx(sum(heights[gaps.argmax() : gaps.argmax() + 2]) / 2) and first.clusters == 5 - (gaps.argmax() + 1)
    assert second.gap == np.argsort(gaps)[::-1][1]
    found = {r.id: r.cluster for r in cluster.ward_labels(frame, height=1.2).collect()}
    assert found[0] == found[1] and len(set(found.values())) == 4
    assert cluster.linkage(frame.where("id < 0")).count() == 0 and cluster.ward_labels(frame.where("id < 0"), 2).count() == 0


def test_ward_in_rounds_gives_the_tree_of_one_task(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=(50, 3)), rng.normal(size=(20, 3)) * 0.1 + 4])
    frame = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(values)], "id string, v array<double>").select("id", array_to_vector("v").alias("features")).repartition(3)
    one, many = (cluster.linkage(frame, n, block=20).orderBy("step").collect() for n in (4000, 12))
    assert [(r.step, r.a, r.b, r.size) for r in many] == [(r.step, r.a, r.b, r.size) for r in one]
    assert [r.height for r in many] == pytest.approx([r.height for r in one])
    for cut in ({"k": 4}, {"height": one[40].height + 1e-9}):
        own, other = ({r.id: r.cluster for r in cluster.ward_labels(frame, limit=n, block=20, **cut).collect()} for n in (4000, 40))
        assert own == other and len(own) == 70


def test_ward_tells_few_candidates_of_a_round(spark, monkeypatch):
    """Of a round's costs exact ones are worked out for few, whatever the blocks; one tree serves the cut and its height."""
    rng = np.random.default_rng(8)
    values = rng.normal(size=(600, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    found, calls = [], []
    nearest, tree = cluster._nearest, cluster.ward_tree
    monkeypatch.setattr(cluster, "_nearest", lambda *a: found.append(nearest(*a)) or found[-1])
    monkeypatch.setattr(cluster, "ward_tree", lambda *a: calls.append(1) or tree(*a))
    labels = {r.id: r.cluster for r in cluster.gap_labels(frame, limit=500).collect()}
    assert calls == [1]
    # a row for each cluster and block that it met
    assert found[0].count() == 600 and cluster._blocks(600, 8, None) == 1 and cluster._blocks(120_000, 64, None) == 16 and cluster._blocks(600_000, 64, None) == 19
    height = cluster.suggested_cut(cluster.linkage(frame)).first().threshold
    want = {r.id: r.cluster for r in cluster.ward_labels(frame, height=height).collect()}
    assert labels == want
    apart = ((values[:, None] - values[None]) ** 2).sum(axis=2) + np.diag(np.full(600, np.inf))
    assert {r.i: r.j for r in found[0].collect()} == dict(enumerate(apart.argmin(axis=1).tolist()))


def test_ward_in_rounds_with_ties(spark):
    """Equal points merge at zero, and every tree over equal distances has as many merges as it must."""
    frame = spark.createDataFrame([(i, [float(i // 5 % 3), 0.0]) for i in range(30)], "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    rows = cluster.linkage(frame, 2, block=4).orderBy("step").collect()
    assert len(rows) == 29 and [r.height for r in rows[:27]] == [0.0] * 27 and rows[-1].size == 30 and rows[27].height > 0
    assert all(r.a < r.b < 30 + r.step for r in rows) and len({n for r in rows for n in (r.a, r.b)}) == 58
    found = {r.id: r.cluster for r in cluster.ward_labels(frame, 3, limit=2, block=4).collect()}
    assert found == {i: i // 5 % 3 + 1 for i in range(30)}


def test_bootstrap_against_drawing_rows(spark):
    rng = np.random.default_rng(5)
    sample = {"a": np.round(rng.gamma(2, 3, 30)), "b": np.round(rng.gamma(2, 3, 45) + 4), "one": np.array([2.0])}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in sample.items() for v in vs] + [("a", None)], "grp string, v double")
    boot = stats.bootstrap_quantile(frame, "grp", "v", 0.75, 4000).cache()
    for g, vs in sample.items():
        own = np.array([r["quantile"] for r in boot.where(F.col("grp") == g).collect()])
        plain = np.quantile(rng.choice(vs, size=(4000, len(vs))), 0.75, axis=1)
        assert len(own) == 4000 and own.mean() == pytest.approx(plain.mean(), abs=0.12) and own.std() == pytest.approx(plain.std(), abs=0.12)
    p = {(r.group1, r.group2): r.p for r in stats.bootstrap_differences(boot, "grp").collect()}
    assert len(p) == 3 and p[("a", "b")] < 0.2 and p[("b", "one")] == 0
    assert boot.exceptAll(stats.bootstrap_quantile(frame.repartition(7), "grp", "v", 0.75, 4000)).count() == 0


def test_random_patterns_lie_in_the_polygon(spark):
    # an L, whose points lie to the upper right of its inner corner nowhere
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    cells = spark.createDataFrame([(1, 400, 2.0, 2.0, corners), (2, 1, 2.0, 2.0, corners)], "cell long, n long, cx double, cy double, corners array<struct<x:double,y:double>>")
    lengths = spatial.random_lengths(cells, "cell", 50)
    rng = np.random.default_rng(1)
    p = rng.random((200000, 2)) * 4
    off = p[(p.min(axis=1) < 1)] - 2
    expected = np.hypot(*(off / np.hypot(off[:, 0], off[:, 1])[:, None]).mean(axis=0))
    rows = lengths.groupBy("cell").agg(F.avg("null_length").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    assert rows[0].n == 50 and rows[0].m == pytest.approx(expected, abs=0.03) and rows[1].m == pytest.approx(1.0)
    square = spark.createDataFrame([(1, float(x), float(y)) for x in (0, 1, 2) for y in (0, 1, 2)] + [(2, 0.0, 0.0)], "cell int, x double, y double")
    outline = spatial.outlined(square, "cell").first()
    assert {(c.x, c.y) for c in outline.corners} == {(0, 0), (0, 2), (2, 0), (2, 2)} and (outline.cx, outline.cy, outline.n) == (1, 1, 9)


def test_zones(spark):
    mask = mask_of(spark, ["#....", "#....", "....."])
    labels = spark.createDataFrame([(0, 0, 1, 1), (0, 2, 4, 2)], "image int, y int, x int, label int")
    flags = {r.label: (r.near, r.dense) for r in zones.context_flags(labels, {"near": zones.around(mask, 5, 3, 1)}, {"dense": labels.where("label = 2")}).collect()}
    assert flags == {1: (1, 0), 2: (0, 1)}
    density = zones.zone_density(labels, zones.around(mask, 5, 3, 1)).first()
    assert (density.n, density.area, density["share"]) == (1, 6, 0.5)
    points = spark.createDataFrame([(0, 1, 40.0, 1.0), (0, 2, 0.0, 1.0), (9, 3, 0.0, 0.0), (0, 4, None, 1.0)], "image int, id int, x double, y double")
    assert {r.id: r.distance for r in zones.distance_to_mask(points, mask, 1.0).collect()} == {1: 40.0, 2: 0.0, 3: None, 4: None}
    assert zones.rim(mask_of(spark, ["###", "###", "###"]), 1).count() == 8


def test_sheets_of_a_directory(spark, tmp_path):
    for name, text in (("golgi_cells", "id,area\n1,2.5\n"), ("golgi_images", "id,path\n1,a\n"), ("er_cells", "id,area\n1,7\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = tables.sheets_of(spark, str(tmp_path), ["golgi"])
    assert sorted(found) == ["golgi_cells", "golgi_images"] and found["golgi_cells"].first().asDict() == {"id": 1, "area": 2.5}
    assert sorted(tables.sheets_of(spark, str(tmp_path), ["golgi", "cells"], "all")) == ["golgi_cells"]
    assert sorted(tables.sheets_of(spark, str(tmp_path), ["golgi"], "none")) == ["er_cells"]
    assert sorted(tables.chosen(found, ["golgi_cells", "absent"])) == ["golgi_cells"]


def test_prepared_sheet(spark):
    sheet = spark.createDataFrame([(i, float(i), 1000.0 if i == 9 else 1.0, None) for i in range(40)], "id int, area_x double, area_y double, area_none double")
    assert clean.prepared(sheet, "id").columns == ["id", "area_x", "area_y"]
    assert clean.prepared(sheet, "id", ["_y"]).columns == ["id", "area_y"]
    assert clean.prepared(sheet, "id", ["_y"], outliers=True).count() == 39
    assert clean.prepared(sheet.limit(0), "id").count() == 0


@pytest.mark.parametrize("parts", [2, 64])
def test_quantiles_of_groups(spark, parts):
    draw = random.Random(parts)
    rows = [("hot", float(draw.randrange(40))) for _ in range(900)] + [("b", draw.random()) for _ in range(7)] + [("one", 3.0), ("none", None), (None, 5.0), (None, 2.0), ("b", None), ("nan", math.nan), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"least": 0.0, "q1": 0.25, "m": 0.5, "high": 0.93, "most": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], "v", shares, parts).collect()}
    assert set(got) == {"hot", "b", "one", None, "nan"}
    for g in ("hot", "b", "one", None):
        own = [v for k, v in rows if k == g and v is not None]
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(float(np.quantile(own, q)), abs=1e-12)
    assert got["nan"].least == 1.0 and math.isnan(got["nan"].most)
    assert quantiles(df.where("g = 'none'"), [], "v", shares).count() == 0
    kept = with_quantiles(df.groupBy("g").agg(F.count("v").alias("n")), df, ["g"], "v", {"m": 0.5})
    assert {r.g: r.m is None for r in kept.collect()} == {g: g == "none" for g in ("hot", "b", "one", "none", None, "nan")}


def test_binomial_model_against_reweighted_least_squares(spark):
    rows = [(line, float(t), float(4 + 2 * t + 3 * (line == "b") + t * t % 3), float(20 - t)) for line in "ab" for t in range(6)]
    df = spark.createDataFrame([*rows, ("a", 1.0, None, 2.0), ("b", 2.0, 0.0, 0.0)], "line string, time double, dead double, alive double")
    coefficients, fitted = models.binomial_model(df, "line + time", "dead", "alive")
    x = np.array([[1.0, line == "a", t] for line, t, _, _ in rows])
    dead, alive = (np.array([r[i] for r in rows]) for i in (2, 3))
    n, beta = dead + alive, np.zeros(3)
    for _ in range(50):
        share = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (n * share * (1 - share))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (dead - n * share))
    error = np.sqrt(np.diag(np.linalg.inv(information)))
    got = {r.term: r for r in coefficients.collect()}
    assert set(got) == {"line_a", "time", "intercept"}
    for i, term in enumerate(("intercept", "line_a", "time")):
        assert got[term].estimate == pytest.approx(beta[i], abs=1e-6) and got[term].error == pytest.approx(error[i], rel=1e-4)
        assert got[term].p == pytest.approx(special.normal_two_sided(beta[i] / error[i]), abs=1e-5)
    assert fitted.count() == len(rows) and fitted.columns == [*df.columns, "fitted"]
    singular = models.binomial_model(df.withColumn("twice", F.col("time") * 2), "time + twice", "dead", "alive")[0]
    assert all(r.error is None and r.p is None for r in singular.collect())


def test_loadings_against_an_eigendecomposition(spark):
    draw = np.random.default_rng(3)
    values = draw.normal(size=(60, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 3.0]])
    df = spark.createDataFrame([tuple(map(float, v)) for v in values] + [(None, 1.0, 1.0)], "a double, b double, c double")
    scaled = (values - values.mean(axis=0)) / values.std(axis=0)
    variances, parts = np.linalg.eigh(np.cov(scaled.T))
    got = {(r.feature, r.component): r for r in cluster.principal_loadings(df, ["a", "b", "c"], 2).collect()}
    for i in (0, 1):
        part = parts[:, 2 - i] * np.sign(parts[np.argmax(np.abs(parts[:, 2 - i])), 2 - i])
        for j, c in enumerate("abc"):
            assert got[c, i + 1].loading == pytest.approx(part[j] * math.sqrt(variances[2 - i]), abs=1e-6)
            assert got[c, i + 1].ratio == pytest.approx(variances[2 - i] / variances.sum(), abs=1e-9)


def test_cuts_that_come_out_otherwise_each_time(spark, monkeypatch):
    # as on a cluster, where parts of the input arrive in any order
    import pandas as pd

    from mensura.operators import running

    @F.pandas_udf("array<double>")
    def any_cuts(values: pd.Series) -> list:
        return sorted(np.random.default_rng().uniform(0, 200, 7).tolist())

    class Functions:
        def __getattr__(self, name):
            return (lambda column, shares: any_cuts(column)) if name == "percentile_approx" else getattr(F, name)

    monkeypatch.setattr(running, "F", Functions())
    df = spark.range(200).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert all(r.s == r.v + 1 for r in running.running_sum(df, ["g"], "v", "n", "s").collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_quantiles_of_counted_values(spark):
    counted = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 4), (None, 7.0, 2), (None, 9.0, 2), ("b", None, 5)], "g string, v double, n long")
    rows = counted.select("g", "v", F.explode(F.sequence(F.lit(1), F.col("n"))))
    shares = {"low": 0.3, "mid": 0.5, "high": 0.8}
    found = {tuple(r) for r in quantiles(counted, ["g"], "v", shares, times="n").collect()}
    assert found == {tuple(r) for r in quantiles(rows, ["g"], "v", shares).collect()} and len(found) == 2
    cuts = [-2.0, 0.0, 0.0, 1.5, 4.0, 4.0]
    values = spark.createDataFrame([(cuts, v) for v in (-3.0, -2.0, 0.0, 0.1, 4.0, math.nan, None)], "c array<double>, v double")
    assert [r[0] for r in values.select(part_of("c", "v", 7)).collect()] == [0, 0, 1, 3, 4, 6, 0]
    summed = running_sum(counted.where("v is not null and g is not null"), ["g"], "v", "n", "upto", parts=3)
    assert sorted((r.v, r.upto) for r in summed.collect()) == [(1.0, 3), (2.0, 4), (5.0, 8)]
