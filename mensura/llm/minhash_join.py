"""Near duplicates by an inverted join of MinHash signatures.

A document's set holds its distinct shingles; equal sets are one node.  The signature of a
set has the least value of its shingle hashes under each of ``COORDINATES`` functions, and
a node is posted under every pair of coordinate and value.  Two sets of a resemblance agree
in a coordinate with that probability, so a pair at the link's resemblance agrees in at
least ``MATCHES`` coordinates but for one pair in 10⁹, and pairs are taken up above that number.

* Prefix: with postings in order of the length of their lists, shortest first, two nodes that
  agree in ``MATCHES`` coordinates share one of their first ``COORDINATES - MATCHES + 1``.
  Postings in lists of one count among these, so a node without near ones posts nothing.
* Skip: nodes known to be linked aren't compared again.  A list whose nodes all belong to one
  component is skipped; short ones pair the nodes of different components, long ones pair
  a leader with those of other components, round by round, at first the node whose
  coordinates most others have, as the original of a crowd of copies has; what is then left of
  long lists is compared in blocks of nodes inside tasks, the lists of one leader together,
  which count collisions, compare the whole sets of what is above the threshold, and give
  links only.  So a crowd of near copies costs some rounds of its size, and no link between
  different components is left out.
* A collision count over the whole signatures, then the whole sets, confirm a pair.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut
from mensura.llm.components import connected_components, joined_unskewed
from mensura.llm.simhash import shingle_hashes

SHINGLE_WORDS = 3
RESEMBLANCE = 0.85
COORDINATES = 64
MISSED = 1e-9
SHORT_LIST = 8
LEADER_ROUNDS = 2
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
_AT_ONCE = 1 << 12
_random = np.random.default_rng(11)
_FACTORS = _random.integers(0, 1 << 63, (COORDINATES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMANDS = _random.integers(0, 1 << 63, (COORDINATES, 1), np.uint64)


def least_matches(resemblance: float = RESEMBLANCE, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The largest number of matches that a pair of the resemblance stays below with at most the probability ``missed``."""
    below = 0.0
    for matches in range(coordinates + 1):
        below += comb(coordinates, matches) * resemblance**matches * (1 - resemblance) ** (coordinates - matches)
        if below > missed:
            return matches
    return coordinates


def shingle_set(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of a whole text's shingles; of one with fewer words, that of them all."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle_words)]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value under each function, as 32 of its bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, (hashes[at : at + _AT_ONCE] * _FACTORS + _SUMMANDS).min(axis=1), out=least)
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _marked(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``set_key`` (a 128-bit hash of the set, null for none), ``size`` and ``signature`` of every row."""

    def of_batches(batches):
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in batch.column(2):
                hashes = shingle_set(str(text), shingle_words)
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sizes.append(len(hashes))
                signatures.append(signature(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "set_key", "size", "signature"],
            )

    return docs.mapInArrow(of_batches, "doc_id long, text_key string, set_key binary, size long, signature array<int>")


def prefixes(nodes: DataFrame, matches: int) -> DataFrame:
    """For each ``node`` the ``tokens`` under which it is posted, and in ``weight`` the length of all its lists.

    Any two nodes with enough matches share one of their tokens.
    """
    token = F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")
    posts = nodes.select("node", F.posexplode("signature").alias("at", "value")).select("node", token.alias("token"))
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posts.join(lists.hint("merge"), "token")
    held = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("posts"))  # COORDINATES at most
    # lists of one come first in the prefix
    left = F.size("posts") - (matches - 1)
    return held.where(left > 0).select("node", F.col("posts.token").alias("tokens"), left.alias("left"), F.aggregate("posts.n", F.lit(0).cast("long"), lambda s, n: s + n).alias("weight")).select("node", "weight", F.slice("tokens", F.lit(1), F.col("left")).alias("tokens"))


def _near_size(a: str, b: str, resemblance: float):
    return F.least(a, b) >= resemblance * F.greatest(a, b)


def _within_blocks(listed: DataFrame, held: DataFrame, matches: int, resemblance: float) -> DataFrame:
    """Links between nodes of different components that share a list, found by blocks of nodes.

    The lists of one leader are taken together, so that a crowd whose nodes share dozens of
    lists is dealt to blocks once; a pair that shares a list shares its leader.  Nodes of the
    component that the leader belongs to, as a crowd's mostly do, are not compared with each
    other: they are sent to the blocks of the other nodes only.
    """

    def blocks(count: str):
        return F.floor(F.greatest((F.col(count) - 1) / BLOCK, F.col(f"size_{count}") / BLOCK_SHINGLES)).cast("int") + 1

    def others(count: str):
        return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.greatest(blocks(count) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    percent = round(100 * resemblance)
    met = listed.select(F.col("leader.node").alias("led"), F.col("leader.label").alias("led_label"), "node", "label", "size").distinct()
    main = F.col("label") == F.col("led_label")
    sums = [F.count(F.when(~main, 1)).alias("n_rest"), F.count(F.when(main, 1)).alias("n_main")]
    sums += [F.coalesce(F.sum(F.when(~main, F.col("size"))), F.lit(0)).alias("size_n_rest"), F.coalesce(F.sum(F.when(main, F.col("size"))), F.lit(0)).alias("size_n_main")]
    met = cut(met)
    counted = met.join(met.groupBy("led").agg(*sums).where("n_rest > 0").hint("merge"), "led")
    own = F.pmod(F.xxhash64("node"), F.when(main, blocks("n_main")).otherwise(blocks("n_rest"))).cast("int")
    # blocks of the main component are numbered downwards from -1
    to_rest = F.transform(others("n_rest"), lambda o: F.when(main, F.struct(o.alias("i"), (-1 - own).alias("j"))).otherwise(F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"))))
    to_main = F.transform(F.when(main, F.array().cast("array<int>")).otherwise(others("n_main")), lambda o: F.struct(own.alias("i"), (-1 - o).alias("j")))
    rows = counted.select("led", "node", "label", "size", F.when(main, -1 - own).otherwise(own).alias("own"), F.explode(F.concat(to_rest, to_main)).alias("_b"))
    rows = rows.select("led", "_b.i", "_b.j", "own", "node", "label", "size").join(held, "node")

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own, size = np.asarray(group.column("own")), np.asarray(group.column("size"))
        label = np.asarray(group.column("label").combine_chunks().dictionary_encode().indices)
        values = np.asarray(group.column("signature").combine_chunks().values).reshape(len(own), COORDINATES)
        hashes = group.column("hashes").combine_chunks()
        ends = np.asarray(hashes.offsets).astype(np.int64)
        shingles = np.unique(np.asarray(hashes.values), return_inverse=True)[1]
        there = np.zeros(len(shingles) + 1, np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in left.tolist():
            ys = right if i != j else right[right > x]
            ys = ys[label[ys] != label[x]]
            ys = ys[np.minimum(size[ys], size[x]) >= resemblance * np.maximum(size[ys], size[x])]
            ys = ys[(values[ys] == values[x]).sum(axis=1) >= matches]
            there[shingles[ends[x] : ends[x + 1]]] = 1
            for y in ys.tolist():
                both = int(there[shingles[ends[y] : ends[y + 1]]].sum())
                if 100 * both >= percent * (size[x] + size[y] - both):
                    a.append(x)
                    b.append(y)
            there[shingles[ends[x] : ends[x + 1]]] = 0
        nodes = group.column("node").combine_chunks()
        return pa.table([nodes.take(pa.array(a, pa.int64())), nodes.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return rows.groupBy("led", "i", "j").applyInArrow(compared, "a long, b long")


def confirmed(pairs: DataFrame, held: DataFrame, matches: int, resemblance: float) -> DataFrame:
    """The pairs that have enough matches and whose whole sets have the resemblance.

    ``b`` may be in any number of pairs; by then rows have the set of ``a``, and adaptive
    execution splits the join by their size.
    """
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("signature").alias("x"), F.col("hashes").alias("s")).hint("merge"), "a").join(
        held.select(F.col("node").alias("b"), F.col("signature").alias("y"), F.col("hashes").alias("t")).hint("merge"), "b"
    )
    tally = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    shared = F.size(F.array_intersect("s", "t"))
    return both.where((tally >= matches) & (100 * shared >= round(100 * resemblance) * (F.size("s") + F.size("t") - shared))).select("a", "b")


def node_links(held: DataFrame, resemblance: float, short_list: int = SHORT_LIST, rounds: int = LEADER_ROUNDS) -> DataFrame | None:
    """``node``, ``label`` of the nodes that have links of at least the resemblance; a label, one of its nodes, stands for all that links reach.

    ``held`` has ``node, size, weight, signature, tokens, hashes`` of the nodes with postings.
    """
    matches = least_matches(resemblance)
    labels = None
    live = held.select("node", "size", "weight", F.explode("tokens").alias("token"))
    for number in range(rounds + 1):
        if labels is None:
            named = live.withColumn("label", F.col("node"))
        else:
            named = cut(live.join(labels, "node", "left").select("token", "node", "size", "weight", F.coalesce("label", "node").alias("label")))
        # in the last round again the most typical node, which many lists then have in common
        first = F.xxhash64("node", F.lit(number)) if 0 < number < rounds else -F.col("weight")
        leader = F.min(F.struct(first.alias("p"), "node", "size", "label"))
        lists = named.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"), leader.alias("leader"))
        # merged at every size: with growing data the lists outgrow a broadcast
        mixed = cut(named.join(lists.where("x <> y").select("token", "n", "leader").hint("merge"), "token"))
        short, long = mixed.where(F.col("n") <= short_list), mixed.where(F.col("n") > short_list)
        other = short.select("token", F.col("node").alias("b"), F.col("size").alias("_size"), F.col("label").alias("_label"))
        near = short.select("token", F.col("node").alias("a"), "size", "label").join(other.hint("merge"), "token")
        pairs = near.where((F.col("a") < F.col("b")) & (F.col("label") != F.col("_label")) & _near_size("size", "_size", resemblance)).select("a", "b")
        if number < rounds:
            led = long.where((F.col("label") != F.col("leader.label")) & _near_size("size", "leader.size", resemblance))
            pairs = pairs.unionByName(led.select(F.col("node").alias("a"), F.col("leader.node").alias("b")))
            # a leader has met all nodes of its list
            live = long.where(F.col("node") != F.col("leader.node")).select("token", "node", "size", "weight")
        else:
            within = _within_blocks(long, held.select("node", "signature", "hashes"), matches, resemblance)
        found = confirmed(pairs.distinct(), held, matches, resemblance)
        found = cut(found.unionByName(within) if number == rounds else found)
        if not found.isEmpty():
            # the links of earlier rounds are as well told by a row a node
            labels = connected_components(found if labels is None else found.unionByName(spokes(labels)))
        if long.isEmpty():
            break
    return labels


def spokes(labels: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` from each node to its label: they reach what the links did."""
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def minhash_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", resemblance: float = RESEMBLANCE, shingle_words: int = SHINGLE_WORDS, short_list: int = SHORT_LIST, rounds: int = LEADER_ROUNDS
) -> DataFrame:
    """Near-duplicate class of every row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked if their sets of distinct shingles, with A to Z in lower case, have at
    least the resemblance; ``component_id`` is the smallest id that links reach.  Texts are
    read whole.  A text of fewer words than a shingle has is one shingle; null and empty texts
    and those without words have none, are linked with nothing and name themselves.  A null id
    never names a class unless all ids of it are null, and is kept only then.  Repeated rows come back as often as they are
    there; other columns are ignored and an empty table gives an empty result.
    """
    matches = least_matches(resemblance)
    text = body(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))
    marked = cut(_marked(docs, shingle_words))
    grouped = marked.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("signature").alias("signature")
    )
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))

    def of_batches(batches):
        for batch in batches:
            sets = [shingle_set(str(t), shingle_words).view(np.int64) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.list_(pa.int64()))], ["node", "size", "signature", "weight", "tokens", "hashes"])

    asked = nodes.select("node", "text_key", "size", "signature").join(prefixes(nodes, matches).hint("merge"), "node")
    some = docs.select("text_key", "text").join(asked, "text_key").dropDuplicates(["node"]).select("text", "node", "size", "signature", "weight", "tokens")
    held = cut(some.mapInArrow(of_batches, "node long, size long, signature array<int>, weight long, tokens array<long>, hashes array<long>"))

    labels = node_links(held, resemblance, short_list, rounds)
    if labels is None:
        named = nodes.select("set_key", F.col("least").alias("component_id"), "n")
    else:
        linked = cut(nodes.join(labels, "node").select("set_key", "label", "least", "n"))
        least = cut(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
        together = joined_unskewed(linked.select("set_key", "label", F.col("n").alias("rows")), least, ["label"]).select("set_key", "component_id", F.col("rows").alias("n"))
        alone = nodes.join(labels, "node", "left_anti").select("set_key", F.col("least").alias("component_id"), "n")
        named = together.unionByName(alone)
    classed = joined_unskewed(marked.where("set_key is not null"), cut(named), ["set_key"]).select("doc_id", "size", "component_id")
    bare = marked.where("set_key is null").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return classed.unionByName(bare).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
