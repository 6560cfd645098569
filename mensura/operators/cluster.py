"""Subtypes: clustering, silhouettes, feature relevance, transfer of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.columns import entropy, margin, ratio
from mensura.functions.lineage import cut, stored
from mensura.operators.components import least_member
from mensura.operators.reshape import long_form
from mensura.operators.running import numbered
from mensura.operators.stats import anova, correlations

WARD_LIMIT = 4000
_BLOCK_VALUES = 1 << 21  # doubles of a block
_TILE = 256, 512  # distances that a task holds at a time
_PIECE = 1 << 14  # sums of distances that are passed on together


def vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def kmeans_labels(df: DataFrame, k: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    """K-means clusters of the column ``features``, numbered from one by size, then by centre."""
    return _numbered_clusters(KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_c").fit(df), df, out)


def _numbered_clusters(model, df: DataFrame, out: str) -> DataFrame:
    labelled = model.transform(df)
    sizes = dict(map(tuple, labelled.groupBy("_c").count().collect()))  # k rows
    centres = [tuple(c) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda c: (-sizes.get(c, 0), centres[c]))
    number = F.element_at(F.array(*[F.lit(order.index(c) + 1) for c in range(len(centres))]), F.col("_c") + 1)
    return labelled.withColumn(out, number).drop("_c")


def within_cost(df: DataFrame, k: int, seed: int = 42) -> float:
    """Squared distance of all rows to the centres of their clusters."""
    if k == 1:
        flat = df.select(F.posexplode(vector_to_array("features")).alias("i", "v"))
        return flat.groupBy("i").agg((F.var_pop("v") * F.count("v")).alias("s")).agg(F.sum("s")).first()[0]
    return KMeans(k=k, seed=seed, featuresCol="features").fit(df).summary.trainingCost


def gap_statistic(df: DataFrame, most: int = 10, references: int = 10, seed: int = 42) -> DataFrame:
    """Gap and its error for each number of clusters; uniform references in the features' box."""
    spark = df.sparkSession
    held = df.select(vector_to_array("features").alias("v")).persist()
    width = len(held.first()["v"])
    ends = held.agg(*[f(F.col("v")[i]) for i in range(width) for f in (F.min, F.max)]).first()
    n = held.count()
    source = held.select(array_to_vector("v").alias("features"))
    rows = []
    for k in range(1, most + 1):
        own = np.log(within_cost(source, k, seed) or 1e-12)
        logs = []
        for b in range(references):
            uniform = F.array(*[F.lit(ends[2 * i]) + (ends[2 * i + 1] - ends[2 * i]) * F.rand(seed * 1000 + b * 100 + i) for i in range(width)])
            logs.append(np.log(within_cost(spark.range(n).select(array_to_vector(uniform).alias("features")), k, seed) or 1e-12))
        rows.append((k, float(np.mean(logs) - own), float(np.std(logs) * np.sqrt(1 + 1 / references))))
    held.unpersist()
    return spark.createDataFrame(rows, "k int, gap double, error double")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``, by one product of matrices.

    Squares lose digits where rows lie close together; these are taken from the differences.
    """
    middle = a.mean(axis=0)
    a, b = a - middle, b - middle
    whole = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
    square = a @ b.T
    square *= -2.0
    square += whole
    whole *= 1e-6
    close = np.flatnonzero(square < whole)
    for at in np.array_split(close, -(-len(close) * a.shape[1] // (1 << 22)) or 1):
        i, j = at // len(b), at % len(b)
        square[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(square, out=square)


def silhouettes(df: DataFrame, label: str, key: str = "id", block: int | None = None) -> DataFrame:
    """Exact silhouette of every row by Euclidean distance.

    Rows are packed in blocks; a task takes pairs of blocks, each once,
    and gives each row of the one the sum of its distances to each cluster of the other.  The work is that of
    all distances, which this measure needs; ``squared_silhouettes`` needs a pass only.
    A row alone in its cluster, or where there is one cluster, has 0; so has one without a label, which is in no cluster.
    """
    value = F.col("silhouettes")[0].alias("silhouette")
    return _silhouettes(df.select(F.col(key).alias("_k"), F.array(F.col(label)).alias("_l"), vector_to_array("features").alias("_v")), 1, block).select(F.col("_k").alias(key), F.col("_l")[0].alias(label), value)


def _silhouettes(rows: DataFrame, clusterings: int, block: int | None) -> DataFrame:
    """Silhouettes of rows ``_k, _l, _v`` by each of their labels ``_l``: ``_k, _l, silhouettes``; distances are worked out once for all.

    What a task adds up stays in the order of its blocks' rows, which the pair of a block
    with itself tells, so that sums meet by pieces of blocks, not by rows.
    """
    held = cut(rows)
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("_k", "_l")}
    counted = held.select(F.posexplode("_l").alias("_at", "_name")).groupBy("_at", "_name").agg(F.count(F.lit(1)).alias("_n")).where("_name is not null")
    sizes = sorted(((r["_at"], r["_name"], r["_n"]) for r in counted.collect()), key=lambda s: (s[0], str(s[1])))  # a row for each cluster
    ends = np.searchsorted([s[0] for s in sizes], np.arange(clusterings + 1))
    codes = [{name: code for code, (at, name, _) in enumerate(sizes) if at == own} for own in range(clusterings)]
    numbers, many = np.array([s[2] for s in sizes], float), max(1, len(sizes))
    count, width = held.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    pairs = _block_pairs(held, ["_k", "_v"], ["_k", "_l", "_v"], "_v", _blocks(count, max(width or 1, many), block))
    piece = max(1, _PIECE // many)

    def coded(labels) -> np.ndarray:
        return np.array([[own.get(name, -1) for own, name in zip(codes, row)] for row in labels], np.int64).reshape(-1, clusterings)

    def members(found: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(found), many + 1))  # the last is of rows without a label
        for own in found.T:
            whole[np.arange(len(found)), own] = 1.0
        return whole[:, :many]

    def summed(frames):
        for frame in frames:
            for own, keys, labels, mine, other, keys2, labels2, yours in frame.itertuples(index=False, name=None):
                a, b = np.asarray(mine).reshape(len(keys), -1), np.asarray(yours).reshape(len(keys2), -1)
                found = coded(labels)
                member, member2 = members(found), members(coded(labels2))
                to_mine, to_yours = np.zeros((len(b), many)), np.zeros((len(a), many))
                for part, some in _tiles(len(a), len(b)):
                    apart = distances(a[part], b[some])
                    to_yours[part] += apart @ member2[some]
                    if own != other:
                        to_mine[some] += apart.T @ member[part]
                for name, partner, sums in [(own, other, to_yours)] + ([(other, own, to_mine)] if own != other else []):
                    for at in range(0, len(sums), piece):
                        told = (keys[at : at + piece], found[at : at + piece].ravel()) if own == other else (None, None)
                        yield pd.DataFrame({"block": [name], "piece": [at], "other": [partner], "sums": [sums[at : at + piece].ravel()], "keys": [told[0]], "codes": [told[1]]})

    def finished(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("other")
        sums = np.sum(np.stack(parts["sums"].tolist()), axis=0).reshape(-1, many)
        keys, found = next((k, np.asarray(c).reshape(-1, clusterings)) for k, c in zip(parts["keys"], parts["codes"]) if k is not None)
        place, values = np.arange(len(sums)), []
        with np.errstate(divide="ignore", invalid="ignore"):
            for own, low, high in zip(found.T, ends, ends[1:]):
                if low == high:
                    values.append(np.zeros(len(sums)))
                    continue
                mine = np.maximum(own - low, 0)
                near, size = sums[:, low:high], numbers[low:high]
                means = near / size
                a = near[place, mine] / (size[mine] - 1)
                means[place, mine] = np.inf
                b = means.min(axis=1)
                value = (b - a) / np.maximum(a, b)
                values.append(np.where((own >= 0) & (size[mine] > 1) & (high - low > 1) & (np.maximum(a, b) > 0), value, 0.0))
        labels = [[None if c < 0 else sizes[c][1] for c in row] for row in found.tolist()]
        return pd.DataFrame({"_k": list(keys), "_l": labels, "silhouettes": list(np.column_stack(values))})

    told = pairs.mapInPandas(summed, f"block int, piece int, other int, sums array<double>, keys array<{kinds['_k']}>, codes array<long>")
    return told.groupBy("block", "piece").applyInPandas(finished, f"_k {kinds['_k']}, _l {kinds['_l']}, silhouettes array<double>")


def squared_silhouettes(df: DataFrame, label: str, key: str = "id") -> DataFrame:
    """Silhouette of every row by *squared* Euclidean distance, from sums by cluster.

    The mean squared distance to a cluster follows from its size, its sum and its sum of
    squares, so that no pairs of rows are made.
    """
    flat = df.select(key, label, F.posexplode(vector_to_array("features")).alias("i", "v"))
    sums = flat.groupBy(label, "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    clusters = sums.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n"))
    clusters = clusters.select(F.col(label).alias("_other"), "s", "q", "n")
    own = df.select(key, label, vector_to_array("features").alias("v")).crossJoin(F.broadcast(clusters))  # a row for each cluster
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dot = F.aggregate(F.zip_with("v", "s", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    apart = F.greatest(square * F.col("n") - 2 * dot + F.col("q"), F.lit(0.0))
    same = F.col(label) == F.col("_other")
    mean = ratio(apart, F.when(same, F.col("n") - 1).otherwise(F.col("n")))
    ab = own.groupBy(key, label).agg(F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"), F.max(F.when(same, F.col("n"))).alias("n"))
    value = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(key, label, value.alias("silhouette"))


def best_k(df: DataFrame, most: int = 9, least: float = 0.0, seed: int = 42, key: str = "id") -> DataFrame:
    """Mean silhouette for each number of clusters; the best is marked, unless under the least.

    All clusterings share one pass over the distances.
    """
    spark, tried, labelled = df.sparkSession, range(2, most + 1), df
    for k in tried:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_c").fit(df)
        labelled = _numbered_clusters(model, labelled, f"_cluster{k}")
    found = _silhouettes(labelled.select(F.col(key).alias("_k"), F.array(*[f"_cluster{k}" for k in tried]).alias("_l"), vector_to_array("features").alias("_v")), len(tried), None)
    means = found.agg(*[F.avg(F.col("silhouettes")[i]) for i in range(len(tried))]).first()
    rows = list(zip(tried, means))
    top = max(rows, key=lambda r: (r[1] or -1, -r[0]))
    return spark.createDataFrame([(k, m, k == top[0] and (m or -1) >= least) for k, m in rows], "k int, silhouette double, best boolean")


def ward_merges(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Merges (left, right, distance, size) of Ward's method, by a chain of nearest neighbours."""
    n = len(points)
    centre, weight = points.astype(float).copy(), weights.astype(float).copy()
    name, alive, chain, merges = list(range(n)), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            cost = 2 * weight * weight[i] / (weight + weight[i]) * ((centre - centre[i]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[i] = np.inf
            if len(chain) > 1 and cost[chain[-2]] <= cost.min():
                j = chain[-2]
                break
            chain.append(int(np.argmin(cost)))
        chain = chain[:-2]
        merges.append((i, j, float(np.sqrt(cost[j]))))
        centre[i] = (centre[i] * weight[i] + centre[j] * weight[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        alive[j] = False
    # merges by height, with clusters named in that order
    parent = list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    out, size = [], {k: weights[k] for k in range(n)}
    for step, (i, j, height) in enumerate(sorted(merges, key=lambda m: m[2])):
        a, b = sorted((find(i), find(j)))
        parent[a] = parent[b] = n + step
        size[n + step] = size[a] + size[b]
        out.append((a, b, height, size[n + step]))
    return np.array(out).reshape(-1, 4)


def ward_cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Cluster of each of ``n`` points when ``k`` are left, numbered from one by first member."""
    parent = list(range(2 * n))
    for step in range(max(0, n - max(1, k))):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        parent[a] = parent[b] = n + step

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    roots = [find(i) for i in range(n)]
    return np.array([list(dict.fromkeys(roots)).index(r) + 1 for r in roots])


def _drawn(x: np.ndarray) -> np.ndarray:
    """Hashes of whole numbers, different for different ones."""
    x = x.astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _blocks(count: int, width: int, block: int | None) -> int:
    """Number of blocks of ``count`` rows that hold ``block`` rows each, if not given 16 MB of ``width`` doubles; sixteen if rows are enough."""
    if block:
        return max(1, -(-count // block))
    return max(1, -(-count * width // _BLOCK_VALUES), min(16, count // 512))


def _block_pairs(rows: DataFrame, by: list[str], columns: list[str], vector: str, blocks: int) -> DataFrame:
    """Pairs of blocks of rows, each once: ``_b``, the columns as arrays, the vectors end to end, and the same of the other block with a 2."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")).groupBy("_b").agg(F.collect_list(F.struct(*columns)).alias("_r"))
    lists = [(F.flatten(f"_r.{c}") if c == vector else F.col(f"_r.{c}")).alias(c) for c in columns]
    packed = cut(dealt.select("_b", *lists).repartition(min(blocks, 64)))  # a task for each pair of parts
    theirs = packed.select(*[F.col(c).alias(f"{c}2") for c in packed.columns])
    return packed.crossJoin(theirs).where("_b <= _b2")


def _tiles(height: int, width: int):
    """Slices of the rows and columns of a matrix, of which a task holds the values of one pair at a time."""
    for at in range(0, height, _TILE[0]):
        for along in range(0, width, _TILE[1]):
            yield slice(at, min(at + _TILE[0], height)), slice(along, min(along + _TILE[1], width))


def _nearest(state: DataFrame, count: int, block: int | None) -> DataFrame:
    """For each of ``count`` clusters ``i, c, w`` the one whose merge costs least.

    Ties go by a hash of the two names, the same from both sides, so that of a crowd of
    equal points a constant share finds each other.  Clusters are packed in blocks and tasks take pairs of blocks, each once; of a block's
    costs only the least for each of its clusters leave the task.
    """
    width = state.agg(F.max(F.size("c"))).first()[0] or 1
    pairs = _block_pairs(state, ["i"], ["i", "c", "w"], "c", _blocks(count, width, block))

    def least(frames):
        for frame in frames:
            for own, names, centres, weights, other, names2, centres2, weights2 in frame.itertuples(index=False, name=None):
                a, b = np.asarray(centres).reshape(len(names), -1), np.asarray(centres2).reshape(len(names2), -1)
                i, j, v, w = map(np.asarray, (names, names2, weights, weights2))
                middle = a.mean(axis=0)
                a0, b0 = a - middle, b - middle
                long, long2 = (a0 * a0).sum(axis=1), (b0 * b0).sum(axis=1)
                # squared distances by one product of matrices; costs so made say which may be least, as they
                # are wrong by less than the margin
                a1, b1 = np.column_stack([a0, long, np.ones(len(a))]), np.column_stack([-2 * b0, np.ones(len(b)), long2])
                light, light2 = 1 / v, 1 / w
                # the margin is that of both costs that are compared
                margin, margin2 = 4e-12 * (long + long2.max()) / (light + light2.min()), 4e-12 * (long2 + long.max()) / (light2 + light.min())
                bound, bound2 = np.full(len(a), np.inf), np.full(len(b), np.inf)
                rows, columns = [], []
                for part, some in _tiles(len(a), len(b)):
                    cost = a1[part] @ b1[some].T
                    cost *= 2
                    cost /= light[part, None] + light2[None, some]
                    if own == other:
                        cost[(part.start + np.arange(len(cost)))[:, None] == some.start + np.arange(cost.shape[1])] = np.inf
                    np.minimum(bound[part], cost.min(axis=1) + margin[part], out=bound[part])
                    may = cost <= bound[part, None]
                    if own != other:
                        np.minimum(bound2[some], cost.min(axis=0) + margin2[some], out=bound2[some])
                        may |= cost <= bound2[some]
                    places = np.flatnonzero(may)
                    places = places[np.isfinite(cost.ravel()[places])]
                    for few in np.array_split(places, -(-len(places) * a.shape[1] // (1 << 22)) or 1):
                        m, n = part.start + few // cost.shape[1], some.start + few % cost.shape[1]
                        exact = 2 * v[m] * w[n] / (v[m] + w[n]) * ((a[m] - b[n]) ** 2).sum(axis=1)
                        draw = _drawn(i[m] ^ j[n])
                        rows.append(picked(exact, draw, i[m], j[n]))
                        if own != other:
                            columns.append(picked(exact, draw, j[n], i[m]))
                for found in (rows, columns):
                    if found:
                        yield picked(*map(np.concatenate, zip(*found)), framed=True)

    def picked(cost, draw, names, others, framed=False):
        order = np.lexsort((draw, cost, names))
        first = order[np.concatenate(([True], np.diff(names[order]) != 0))] if len(order) else order
        best = cost[first], draw[first], names[first], others[first]
        return pd.DataFrame(dict(zip(["cost", "draw", "i", "j"], best)))[["i", "cost", "draw", "j"]] if framed else best

    return pairs.mapInPandas(least, "i long, cost double, draw long, j long").groupBy("i").agg(F.min(F.struct("cost", "draw", "j")).alias("m")).select("i", "m.cost", "m.j").where("cost < double('infinity')")


def ward_tree(points: DataFrame, count: int, limit: int = WARD_LIMIT, block: int | None = None) -> DataFrame:
    """Ward's merges of ``count`` points ``i, c``, numbered from zero: ``node, left, right, height, size``.

    In each round all clusters that are each other's nearest merge: no merge brings a third
    cluster nearer than the nearer of its parts was, so that these merges are those of the
    plain method, whose order is by ``height``, then ``node``.  The last ``limit`` clusters
    are merged in one task.  A round compares all clusters, block by block; rounds follow
    the longest chain of ever nearer neighbours, some dozens for points that don't lie in
    a row of growing distances.
    """
    state = cut(points.select("i", "c", F.lit(1.0).alias("w"), F.lit(0.0).alias("top"), F.col("i").alias("node")))
    merges, left, rounds = [], count, 0
    while left > limit:
        near = stored(_nearest(state, left, block))
        pairs = near.join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"]).where("i < j")
        one = state.select("i", *[F.col(c).alias(f"{c}1") for c in ("c", "w", "top", "node")])
        two = state.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in ("c", "w", "top", "node")])
        weight = F.col("w1") + F.col("w2")
        centre = F.transform(F.arrays_zip("c1", "c2"), lambda e: (e["c1"] * F.col("w1") + e["c2"] * F.col("w2")) / weight)
        height = F.greatest(F.sqrt("cost"), "top1", "top2")
        made = stored(pairs.join(one, "i").join(two, "j").select("i", "j", centre.alias("c"), weight.alias("w"), height.alias("top"), (F.col("i") + count * (rounds + 1)).alias("node"), "node1", "node2"))
        merges.append(made.select("node", F.col("node1").alias("left"), F.col("node2").alias("right"), F.col("top").alias("height"), F.col("w").alias("size")))
        gone = made.select(F.explode(F.array("i", "j")).alias("i"))
        state = stored(state.join(gone, "i", "left_anti").unionByName(made.select("i", "c", "w", "top", "node")))
        left, rounds = state.count(), rounds + 1
    first = count * (rounds + 1)

    def rest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        found = ward_merges(np.array(rows["c"].tolist(), float).reshape(len(rows), -1), rows["w"].to_numpy())
        nodes, tops, out = rows["node"].tolist(), rows["top"].tolist(), []
        for a, b, height, size in found.tolist():
            a, b = int(a), int(b)
            tops.append(max(height, tops[a], tops[b]))
            nodes.append(first + len(out))
            out.append((nodes[-1], nodes[a], nodes[b], tops[-1], size))
        return pd.DataFrame(out, columns=["node", "left", "right", "height", "size"])

    # ``limit`` rows
    tree = cut(state.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(rest, "node long, left long, right long, height double, size double"))
    for part in merges:
        tree = tree.unionByName(part)
    return tree


def _numbered_points(df: DataFrame, key: str) -> DataFrame:
    """Rows ``i, key, c``, numbered from zero by key, repeated keys by their values."""
    held = df.select(F.col(key).alias("_key"), vector_to_array("features").alias("c"))
    return cut(numbered(held.withColumn("_u", F.monotonically_increasing_id()), ["_key", "c", "_u"], "i").select("i", "_key", "c"))


def _steps(tree: DataFrame, count: int) -> DataFrame:
    """The merges of a tree with their ``step`` in order of height; a node of a merge is the number of points and the step."""
    ordered = cut(numbered(tree, ["height", "node"], "step"))
    names = ordered.select(F.col("node").alias("_n"), (F.col("step") + count).alias("_s"))
    for side in ("left", "right"):
        ordered = ordered.join(names.withColumnsRenamed({"_n": side, "_s": f"_{side}"}), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return ordered.select(F.col("step").cast("int").alias("step"), F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "height", "size")


def _ward_points(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_cell"), vector_to_array("features").alias("c"), F.lit(1.0).alias("w"))


def _merged(rows: pd.DataFrame) -> tuple[pd.Series, np.ndarray]:
    rows = rows.sort_values("_cell")
    return rows["_cell"], ward_merges(np.array(rows["c"].tolist(), float).reshape(len(rows), -1), rows["w"].to_numpy())


def linkage(df: DataFrame, limit: int = WARD_LIMIT, key: str = "id", block: int | None = None) -> DataFrame:
    """Ward's merges in order: ``step`` from zero, the clusters ``a < b`` merged, ``height`` and ``size``.

    Points are numbered from zero by key, the cluster of a step by the number of points and
    the step.  Up to ``limit`` rows are merged in one task; of more, clusters that are each
    other's nearest merge in rounds until that many are left, which gives the same tree.
    """
    count = df.count()
    if count > limit:
        return _steps(ward_tree(_numbered_points(df, key), count, limit, block), count)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        _, m = _merged(rows)
        return pd.DataFrame({"step": np.arange(len(m)), "a": m[:, 0].astype(int), "b": m[:, 1].astype(int), "height": m[:, 2], "size": m[:, 3]})

    return _ward_points(df, key).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(table, "step int, a long, b long, height double, size double")  # ``limit`` rows


def suggested_cut(merges: DataFrame, place: int = 1) -> DataFrame:
    """Height midway in the ``place``-th largest gap between successive merges, and the clusters that a cut there leaves.

    Of equal gaps the later counts as larger.
    """
    held = cut(merges.select("step", "height"))
    after = held.select((F.col("step") - 1).alias("step"), F.col("height").alias("_next"))
    largest = held.join(after, "step").orderBy((F.col("_next") - F.col("height")).desc(), F.col("step").desc()).limit(place)
    ranked = largest.withColumn("_k", F.row_number().over(Window.orderBy((F.col("_next") - F.col("height")).desc(), F.col("step").desc())))  # ``place`` rows
    return ranked.where(F.col("_k") == place).select(((F.col("height") + F.col("_next")) / 2).alias("threshold"), (F.lit(held.count()) - F.col("step")).cast("int").alias("clusters"), F.col("step").alias("gap"))


def ward_labels(df: DataFrame, k: int | None = None, limit: int = WARD_LIMIT, key: str = "id", height: float | None = None, block: int | None = None) -> DataFrame:
    """Ward clusters of the column ``features``: ``k`` of them, or those left by a cut at a height.

    Numbered from one by their first members.  Up to ``limit`` rows are merged in one task;
    of more, the tree of :func:`ward_tree` is cut, and its clusters are the components of
    the merges kept.
    """
    count = df.count()
    if count > limit:
        points = _numbered_points(df, key)
        steps = _steps(ward_tree(points, count, limit, block), count)
        return _left_by(points, count, steps.where(F.col("step") < count - max(1, k)) if height is None else steps.where(F.col("height") <= height), key)
    cells = _ward_points(df, key)

    def labelled(rows: pd.DataFrame) -> pd.DataFrame:
        names, merges = _merged(rows)
        left = k if height is None else len(names) - int((merges[:, 2] <= height).sum())
        return pd.DataFrame({"_cell": names, "cluster": ward_cut(merges, len(names), left)})

    # at most ``limit`` rows meet
    clusters = cells.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(labelled, f"_cell {cells.schema['_cell'].dataType.simpleString()}, cluster int")
    return clusters.select(F.col("_cell").alias(key), "cluster")


def gap_labels(df: DataFrame, place: int = 1, limit: int = WARD_LIMIT, key: str = "id", block: int | None = None) -> DataFrame:
    """Ward clusters left by the :func:`suggested_cut` of their own tree, which is made once for both if it has more than ``limit`` points."""
    count = df.count()
    if count <= limit:
        height = suggested_cut(linkage(df, limit, key, block), place).first()["threshold"]
        return ward_labels(df, limit=limit, key=key, height=height, block=block)
    points = _numbered_points(df, key)
    steps = cut(_steps(ward_tree(points, count, limit, block), count))
    return _left_by(points, count, steps.where(F.col("height") <= suggested_cut(steps, place).first()["threshold"]), key)


def _left_by(points: DataFrame, count: int, kept: DataFrame, key: str) -> DataFrame:
    """Clusters of numbered points after the merges kept, numbered from one by their first members."""
    edges = kept.select((F.col("step") + count).alias("a"), F.explode(F.array("a", "b")).alias("b"))
    roots = cut(least_member(points.select(F.col("i").alias("id")), edges))
    names = numbered(roots.select("root").distinct(), ["root"], "_c").select("root", (F.col("_c") + 1).cast("int").alias("cluster"))
    return points.join(roots.join(names, "root"), points["i"] == roots["id"]).select(F.col("_key").alias(key), "cluster")


def principal_scores(df: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Scores of centred features on the first components; each has its largest loading positive."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(df).transform(df)
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(centred)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, c])), c]) or 1) for c in range(k)]
    scores = model.transform(centred).select(key, vector_to_array("_s").alias("s"))
    return scores.select(key, *[(F.col("s")[c] * signs[c]).alias(f"pc{c + 1}") for c in range(k)])


def principal_loadings(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Loadings of standardised columns on their first components: ``feature``, ``component`` from 1, ``loading``, ``ratio``.

    A loading is the coefficient times the root of the component's variance, where the
    largest coefficient is positive; ``ratio`` is the share of variance that the component
    explains.  Columns are scaled by their population deviation; rows with nulls fall out.
    """
    whole = vectors(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna(), columns)
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_c").fit(whole).transform(whole)
    n = whole.count()
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(scaled)
    parts, ratios = model.pc.toArray(), model.explainedVariance.toArray()
    # scaled by the sample deviation each column has a variance of one; by the population's n / (n - 1)
    varying = [c for c, v in zip(columns, whole.agg(*[F.var_samp(c).alias(c) for c in columns]).first()) if v]
    total = len(varying) * n / max(n - 1, 1)
    rows = []
    for i in range(k):
        sign = float(np.sign(parts[np.argmax(np.abs(parts[:, i])), i]) or 1)
        rows += [(c, i + 1, float(sign * parts[j, i] * np.sqrt(ratios[i] * total)), float(ratios[i])) for j, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double, ratio double")


def components_for(df: DataFrame, share: float) -> int:
    """Number of components that explain a share of the variance."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(df).transform(df)
    width = len(centred.first()["_c"])
    explained = PCA(k=width, inputCol="_c", outputCol="_s").fit(centred).explainedVariance.toArray()
    return int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)


def relevance(df: DataFrame, columns: list[str], label: str, most: int) -> DataFrame:
    """Features in order of choice: F over the mean absolute correlation with those chosen before."""
    f = {r.feature: r.f for r in anova(long_form(df, [label], columns), label, ["feature"]).collect()}  # a row for each feature
    r = {frozenset((x.feature1, x.feature2)): abs(x.r or 0.0) for x in correlations(df, columns).collect()}
    chosen: list[tuple[str, float]] = []
    while len(chosen) < min(most, len(columns)):
        left = [c for c in columns if c not in dict(chosen)]

        def score(c: str) -> float:
            redundancy = np.mean([r[frozenset((c, d))] for d, _ in chosen]) if chosen else 1.0
            return (f.get(c) or 0.0) / max(float(redundancy), 1e-12)

        best = max(left, key=lambda c: (score(c), c))
        chosen.append((best, score(best)))
    return df.sparkSession.createDataFrame([(i + 1, c, s) for i, (c, s) in enumerate(chosen)], "place int, feature string, score double")


def fit_forest(df: DataFrame, label: str, trees: int = 100, depth: int = 10, seed: int = 42):
    """Random forest on ``features`` with an indexed label from zero."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol="features").fit(df)


def transferred(model, df: DataFrame) -> DataFrame:
    """Predicted class with its probability, margin and entropy."""
    p = vector_to_array("probability")
    return model.transform(df).withColumns({"confidence": F.array_max(p), "margin": margin(p), "entropy": entropy(p)})


def out_of_fold(df: DataFrame, label: str, folds: int = 5, key: str = "id", **forest) -> DataFrame:
    """Accuracy of each fold, dealt by hash of the key."""
    spark, rows = df.sparkSession, []
    dealt = df.withColumn("_f", F.pmod(F.xxhash64(key), F.lit(folds)))
    for fold in range(folds):
        model = fit_forest(dealt.where(F.col("_f") != fold), label, **forest)
        held = model.transform(dealt.where(F.col("_f") == fold))
        rows.append((fold, held.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]))
    return spark.createDataFrame(rows, "fold int, accuracy double")


def reclustered(df: DataFrame, confidence: str, threshold: float, k: int, label: str) -> DataFrame:
    """Labels, with rows of low confidence clustered anew into ``new1``, ``new2`` and so on."""
    sure = df.where(F.col(confidence) > threshold).withColumn("subtype", F.col(label).cast("string"))
    rest = df.where(F.coalesce(F.col(confidence) <= threshold, F.lit(True)))
    if rest.isEmpty():
        return sure
    fresh = kmeans_labels(rest, k, out="_n").withColumn("subtype", F.concat(F.lit("new"), F.col("_n"))).drop("_n")
    return sure.unionByName(fresh)
