"""Objects followed from frame to frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost, by shortest augmenting paths."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[j0] = True
            row = match[j0]
            slack = c[row - 1] - u[row] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = 1 + int(np.argmin(np.where(seen[1:], np.inf, least[1:])))
            step = least[j1]
            u[match[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def frame_overlaps(labels: DataFrame) -> DataFrame:
    """Places that each label shares with each label of the frame before, and both areas."""
    areas = labels.groupBy("series", "t", "label").agg(F.count(F.lit(1)).alias("area"))
    now = labels.withColumnRenamed("label", "b")
    before = labels.select("series", (F.col("t") + 1).alias("t"), "y", "x", F.col("label").alias("a"))
    shared = now.join(before, ["series", "t", "y", "x"]).groupBy("series", "t", "a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    return shared.join(areas.select("series", "t", F.col("label").alias("b"), F.col("area").alias("b_area")), ["series", "t", "b"]).join(
        areas.select("series", (F.col("t") + 1).alias("t"), F.col("label").alias("a"), F.col("area").alias("a_area")), ["series", "t", "a"]
    )


def match_frames(overlaps: DataFrame, least_overlap: float = 0.1, least_iou: float = 0.05) -> DataFrame:
    """One-to-one matches of successive frames with the most overlap in total.

    A match stands if the overlap is enough of the earlier label or of the union.  Frames
    are independent here: ids are carried along by :func:`track_ids`.
    """

    def matched(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].unique(), rows["b"].unique()
        cost = np.zeros((len(a), len(b)))
        at = {k: i for i, k in enumerate(a)}, {k: i for i, k in enumerate(b)}
        cost[rows["a"].map(at[0]), rows["b"].map(at[1])] = -rows["overlap"]
        pairs = {(a[i], b[j]) for i, j in assignment(cost) if cost[i, j] < 0}
        kept = rows[[p in pairs for p in zip(rows["a"], rows["b"])]]
        share = kept["overlap"] / kept["a_area"]
        iou = kept["overlap"] / (kept["a_area"] + kept["b_area"] - kept["overlap"])
        return kept[(share >= least_overlap) | (iou >= least_iou)][["series", "t", "a", "b", "overlap"]]

    return overlaps.groupBy("series", "t").applyInPandas(matched, "series long, t long, a long, b long, overlap long")


def mutual_best(overlaps: DataFrame) -> DataFrame:
    """Matches of labels that are each other's largest overlap; ties go by label."""
    left = overlaps.groupBy("series", "t", "a").agg(F.max_by("b", F.struct("overlap", -F.col("b"))).alias("b"))
    right = overlaps.groupBy("series", "t", "b").agg(F.max_by("a", F.struct("overlap", -F.col("a"))).alias("a"))
    return left.join(right, ["series", "t", "a", "b"]).select("series", "t", "a", "b")


def track_ids(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """A track for every label of every frame, named by where it starts.

    Matches are links of a chain, one before and one after at most; the chains are the
    components of the matches, whatever the length of the series.
    """
    from mensura.operators.components import least_member

    def node(t, label):
        return F.struct(F.col("series").alias("series"), t.alias("t"), label.alias("label"))

    nodes = labels.select("series", "t", "label").distinct().withColumn("id", node(F.col("t"), F.col("label")))
    edges = matches.select(node(F.col("t") - 1, F.col("a")).alias("a"), node(F.col("t"), F.col("b")).alias("b"))
    return nodes.join(least_member(nodes, edges), "id").select("series", "t", "label", F.col("root.t").alias("first_t"), F.col("root.label").alias("first_label"))
