"""Near-duplicate documents by SimHash and an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most ``radius`` bits differ in at most that many
of their eight bytes, so they share at least ``8 - radius`` bytes by position.  The index
posts every distinct fingerprint under each way to choose that many positions; a pair that
reaches the guaranteed number of shared positional bytes meets in at least one list, and
is taken up only in the list of its first shared positions, so that its tally and its
distance are worked out once.

A list of up to ``short_list`` fingerprints is joined with itself.  The fingerprints of
longer ones, which a crowd of near copies makes, are instead posted under every value up
to half the radius from them: two fingerprints within the radius share such a midpoint, and
any two that share one are within the radius, so an edge from each to the least of its
midpoint links the same components with rows in proportion to the crowd.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut, shuffle_width
from mensura.llm.components import connected_components, joined_unskewed

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
SHORT_LIST = 64
_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SHINGLES_AT_ONCE = 1 << 15


def shingle_hashes(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one whole text, repeats included, some at a time; nothing if it has no words."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    first, last, digest = starts[: len(last)].tolist(), last.tolist(), xxhash.xxh64_intdigest
    for at in range(0, len(last), _SHINGLES_AT_ONCE):
        part = slice(at, at + _SHINGLES_AT_ONCE)
        yield np.array([digest(line[a:b], seed) for a, b in zip(first[part], last[part])], np.uint64)


def majority_bits(hashes: Iterable[np.ndarray]) -> int:
    """SimHash of shingle hashes as a signed 64-bit integer: the bits set in over half of them."""
    ones, count = np.zeros(64, np.int64), 0
    for part in hashes:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * ones > count).view(np.int64)[0])


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one whole text as a signed 64-bit integer; zero if it has no words."""
    return majority_bits(shingle_hashes(text, shingle_words, seed))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and the 64-bit ``fp`` of every row's whole text; a null text is empty."""

    def of_batches(batches):
        for batch in batches:
            values = [fingerprint(str(t)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values, pa.int64())], ["doc_id", "text_hash", "fp"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body(text_col)).alias("text_hash"), body(text_col).alias("text"))
    return docs.mapInArrow(of_batches, "doc_id long, text_hash long, fp long")


def _same_bytes(x: Column, y: Column) -> Column:
    """Bit p is set if x and y share byte p."""
    differ = x.bitwiseXOR(y)
    bits = [F.when(differ.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0, 1 << p).otherwise(0) for p in range(8)]
    return sum(bits[1:], bits[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(nodes: DataFrame, radius: int = RADIUS, short_list: int = SHORT_LIST) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` within ``radius`` bits."""
    spark = nodes.sparkSession
    chosen = list(combinations(range(8), 8 - radius))
    masks = [_signed(sum(0xFF << 8 * p for p in c)) for c in chosen]
    places = [sum(1 << p for p in c) for c in chosen]
    # the first choice of positions that lies within a set of shared ones
    first = [next((i for i, m in enumerate(places) if m & shared == m), -1) for shared in range(256)]

    spread = cut(nodes.select("fp").repartition(shuffle_width(spark), "fp"))
    index = spread.select("fp", F.posexplode(F.array(*map(F.lit, masks))).alias("list", "mask")).select(
        F.col("list").cast("short").alias("list"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    lists = cut(index.groupBy("list", "key").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1"))
    # merged at every size: with growing data the lists outgrow a broadcast
    posts = cut(index.join(lists.hint("merge"), ["list", "key"]))

    def near(pairs: DataFrame) -> DataFrame:
        tally = F.element_at(F.array(*map(F.lit, first)), _same_bytes(F.col("a"), F.col("b")) + 1)
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        return pairs.where((tally == F.col("list")) & (apart <= radius)).select("a", "b")

    short = posts.where(f"n <= {short_list}").drop("n")
    found = near(
        short.withColumnRenamed("fp", "a")
        .join(short.withColumnRenamed("fp", "b"), ["list", "key"])
        .where("a < b")
    )

    crowd = cut(posts.where(f"n > {short_list}").select("fp").distinct())
    if crowd.isEmpty():
        return found
    steps = [_signed(sum(1 << b for b in flips)) for size in range(radius // 2 + 1) for flips in combinations(range(64), size)]
    posted = crowd.repartition(shuffle_width(spark), "fp").select("fp", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    posted = posted.select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("mid"))
    stars = cut(posted.groupBy("mid").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a")).where("n > 1").select("mid", "a"))
    spokes = posted.join(stars.hint("merge"), "mid").where("a <> fp").select("a", F.col("fp").alias("b"))
    return found.unionByName(spokes.distinct())


def _classed(df: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` of every row, and in ``least`` id and hash of the least row of its class."""
    prints = cut(fingerprints(df, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")))
    return prints.join(classes_of(nodes, links(nodes, radius), "fp"), "fp")


def classes_of(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes ``key`` with the least of the column ``least`` over what the edges ``(a, b)`` reach."""
    labels = cut(connected_components(edges).select(F.col("node").alias(key), "label"))
    linked = cut(nodes.join(labels, key).select(key, "label", "least"))
    named = cut(linked.groupBy("label").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")))
    classed = joined_unskewed(linked.select(key, "label"), named, ["label"]).select(key, "least")
    alone = nodes.join(labels, key, "left_anti").select(key, "least")
    return cut(classed.unionByName(alone))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Near-duplicate class of every row of ``df``.

    Returns ``doc_id``, ``fp`` (signed 64 bits) and ``component_id``, the smallest id that
    can be reached over fingerprints at most ``radius`` (an even number below 8) bits apart.

    Texts of any length are read whole.  A null text counts as empty, an empty table gives
    an empty result, other columns are ignored; texts without words have fingerprint zero and are linked
    like any other.  Rows with null ids are classed and never name a class unless all ids
    of it are null.  Repeated rows come back as often as they are there.
    """
    return _classed(df, id_col, text_col, radius).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows of ``df`` with one document, that of the smallest id, of each near-duplicate class.

    All columns stay, whatever their names.  A row with a null id stays only if no row of
    its class has an id; of rows that repeat id and text one stays.  Null texts are empty,
    and an empty table gives an empty result.
    """
    return keep_least(df, _classed(df, id_col, text_col, radius), id_col, text_col)


def keep_least(df: DataFrame, classed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``df`` that are the least of their class, once each, given ``doc_id``, ``text_hash`` and ``least`` of every row."""
    held = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body(text_col)).alias("text_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    found = cut(classed.select("doc_id", "text_hash", stays.alias("stays")))
    gone = found.where("not stays").select("doc_id", "text_hash").distinct()
    repeats = cut(found.where("stays").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash"))

    def among(rows: DataFrame, kind: str, some: DataFrame) -> DataFrame:
        return rows.join(some, rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["text_hash"] == some["text_hash"]), kind)

    rest = among(held, "left_anti", gone)
    if not repeats.isEmpty():
        once = among(rest, "left_semi", repeats).dropDuplicates(["doc_id", "text_hash"])
        rest = among(rest, "left_anti", repeats).unionByName(once)
    return rest.select("row.*")
