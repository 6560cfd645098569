"""Near copies by the resemblance of their shingles: SimHash index and MinHash signatures propose, an exact check decides.

Texts are candidates if the SimHashes of their five-word shingles are linked by the
inverted index of byte positions (:mod:`mensura.llm.simhash`).  At a resemblance of 0.8,
SimHashes of 64 bits are some ten bits apart, beyond what eight bytes can guarantee, so
the index alone misses most such pairs.  Therefore the signatures of the same shingle
hashes are joined as in :mod:`mensura.llm.minhash_join`: a pair at that resemblance is
proposed but for one in 10⁹, in crowds as elsewhere, as only texts that are known to be
of one class aren't compared.  Candidates are linked if the resemblance of their whole
shingle sets is at least the threshold; those of the index whatever their signatures say.
Texts of equal sets, which have a resemblance of one, are one node, named by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut
from mensura.llm.components import joined_unskewed
from mensura.llm.minhash_join import confirmed, least_matches, node_links, prefixes, signature, spokes
from mensura.llm.simhash import classes_of, keep_least, majority_bits, shingle_hashes
from mensura.llm.simhash import links as within_bits

SHINGLE_WORDS = 5
RESEMBLANCE = 0.8
SHORT_LIST = 8


def shingles(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles; a text of fewer words has one of them all, one without words none."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle_words)]))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", resemblance: float = RESEMBLANCE, short_list: int = SHORT_LIST) -> DataFrame:
    """Rows of ``df`` with one document, that of the smallest id, of each class of near copies.

    Texts of any length are linked by the resemblance of their five-word shingles, a class
    is what links reach.  Texts without words, null and empty ones too, are alike.  All
    columns stay, whatever their names.  A row with a null id stays only if no row of its
    class has an id; of rows that repeat id and text one stays.  An empty table gives an
    empty result.
    """

    def of_batches(batches):
        for batch in batches:
            keys, sizes, prints, signatures = [], [], [], []
            for text in batch.column(3):
                hashes = list(shingle_hashes(str(text), SHINGLE_WORDS))
                own = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(majority_bits(hashes))
                signatures.append(signature(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "text_key", "set_key", "size", "fp", "signature"],
            )

    def sets(batches):
        for batch in batches:
            found = [shingles(str(t)).view(np.int64) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int64()))], ["node", "size", "signature", "weight", "tokens", "hashes"])

    matches, text = least_matches(resemblance), body(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.md5(text).alias("text_key"), text.alias("text"))
    marked = cut(docs.mapInArrow(of_batches, "doc_id long, text_hash long, text_key string, set_key binary, size long, fp long, signature array<int>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    grouped = marked.groupBy("set_key").agg(least, F.count(F.lit(1)).alias("n"), F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("size", "fp", "signature")])
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))

    proposed = cut(_by_index(nodes.select("node", "fp")))
    tokens = prefixes(nodes, matches).select("node", "weight", "tokens").unionByName(
        proposed.select(F.explode(F.array("a", "b")).alias("node"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<long>").alias("tokens"))
    )
    posted = tokens.groupBy("node").agg(F.max("weight").alias("weight"), F.flatten(F.collect_set("tokens")).alias("tokens"))  # a prefix at most
    asked = nodes.select("node", "text_key", "size", "signature").join(posted.hint("merge"), "node")
    some = docs.select("text_key", "text").join(asked, "text_key").dropDuplicates(["node"]).select("text", "node", "size", "signature", "weight", "tokens")
    held = cut(some.mapInArrow(sets, "node long, size long, signature array<int>, weight long, tokens array<long>, hashes array<long>"))

    edges = cut(confirmed(proposed, held, 0, resemblance))
    labels = node_links(held, resemblance, short_list)
    if labels is not None:
        edges = edges.unionByName(spokes(labels))
    classes = classes_of(nodes.select("node", "least"), edges, "node")
    named = cut(nodes.select("node", "set_key", "n").join(classes, "node").select("set_key", "n", "least"))
    classed = joined_unskewed(marked.select("doc_id", "text_hash", "set_key"), named, ["set_key"]).select("doc_id", "text_hash", "least")
    return keep_least(df, classed, id_col, text_col)


def _by_index(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that the index links: each with one of its SimHash, and one each of linked SimHashes."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("t")))
    linked = within_bits(first.select("fp"))
    across = linked.join(first.select(F.col("fp").alias("a"), F.col("t").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("t").alias("y")), "b").select("x", "y")
    same = nodes.join(first, "fp").where("node <> t").select(F.col("node").alias("x"), F.col("t").alias("y"))
    return across.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
