"""Ranked lexical search over posting lists in geometric blocks with exact summaries.

A document is a sparse vector of integer impacts, one for each term that some item asks for;
an item is a vector of term weights, and a score their product.

* Every posting list is dealt into chunks of bounded size by a hash.  Within a chunk the
  documents are clustered by similarity: some of them stand for a block each, and every
  document joins the one with which its product is largest.  A block keeps its documents'
  vectors and a summary, the largest impact of each coordinate.
* An item's product with a summary is at least its score of every document of the block.  A
  block is skipped only if that bound is below the item's threshold, which is the score of
  the ``k``-th best document found so far.
* Thresholds start from the documents with the item's rarest terms.  Terms whose greatest
  impacts together can't reach the threshold needn't be looked up: a document that has no
  other term can't be among the best.  Lists are made of the other, essential, terms only.
* A document stands in the list of each of its terms but is scored for an item in that of
  the item's rarest essential term only.

Which documents are seeds and how they are clustered decides how much is skipped, not what
is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from math import floor, log
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import body, checkpoint_root, cut

BEST = 20
ITEMS_AT_ONCE = 4096
CHUNK = 1024
BLOCK = 32
SEEDS = 32
# Fixed value: the separators of terms; all other characters belong to terms, A to Z in lower case.
_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_FOLDED = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str) -> list[bytes]:
    """Terms of a whole text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def impact(tf, n, n_documents: int, n_terms: int):
    """The share of a term's weight that a document of ``n`` terms with ``tf`` of it scores, in 10⁻⁶."""
    m = 75 + (25 * n * n_documents) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass(frozen=True)
class Asked:
    """Items of one block as vectors over their own terms."""

    terms: list[np.ndarray]  # ascending
    weights: list[np.ndarray]
    essential: list[np.ndarray] = field(default_factory=list)  # rarest first
    threshold: list[int] = field(default_factory=list)
    n_coordinates: int = 0

    @cached_property
    def askers(self) -> dict[int, list[int]]:
        """Items by essential term."""
        found: dict[int, list[int]] = {}
        for item, terms in enumerate(self.essential):
            for t in terms.tolist():
                found.setdefault(t, []).append(item)
        return found

    @cached_property
    def coordinates(self) -> dict[int, np.ndarray]:
        """For each essential term, the terms of the items that look it up."""
        return {t: np.unique(np.concatenate([self.terms[i] for i in items])) for t, items in self.askers.items()}


def vectors(df: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, number ``n`` of all terms, and ``terms``, ``tfs`` of those in the vocabulary, for every row."""
    shared = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # terms of ITEMS_AT_ONCE items

    def of_batches(batches):
        known = shared.value
        for batch in batches:
            sizes, bounds, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(str(text))
                held = Counter(filter(None.__ne__, map(known.get, words)))
                order = sorted(held)
                sizes.append(len(words))
                terms += order
                tfs += map(held.__getitem__, order)
                bounds.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return docs.mapInArrow(of_batches, "doc_id long, n long, terms array<int>, tfs array<int>")


class Vectors:
    """The documents of an Arrow batch with their coordinates one after another."""

    def __init__(self, batch: pa.RecordBatch):
        def column(name):
            return batch.column(batch.schema.get_field_index(name))

        self.ids = np.asarray(column("doc_id").fill_null(_NO_ID))
        self.bounds = np.asarray(column("terms").offsets).astype(np.int64)
        self.terms = np.asarray(column("terms").values)
        self.impacts = np.asarray(column("impacts").values)

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, terms and impacts of some documents."""
        return taken(self.bounds, self.terms, self.impacts, rows)


def taken(bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = bounds[rows + 1] - bounds[rows]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts - bounds[rows], sizes)
    return np.append(starts, sizes.sum()), terms[place], impacts[place]


def _products(starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Product of every vector with dense weights."""
    sums = np.concatenate(([0], np.cumsum(weight[terms] * impacts.astype(np.int64))))
    return sums[starts[1:]] - sums[starts[:-1]]


class Best:
    """The ``k`` best documents of every item that a task has met, and the threshold that follows."""

    def __init__(self, k: int, threshold: list[int]):
        self.k, self.threshold = k, dict(enumerate(threshold))
        self._found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self._waiting: Counter = Counter()

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        there = scores >= max(1, self.threshold[item])
        if there.any():
            self._found.setdefault(item, []).append((ids[there], scores[there]))
            self._waiting[item] += int(there.sum())
            if self._waiting[item] >= 4 * self.k:
                self._settle(item)

    def _settle(self, item: int) -> None:
        ids, scores = (np.concatenate(x) for x in zip(*self._found[item]))
        order = np.lexsort((ids, -scores))[: self.k]
        self._found[item] = [(ids[order], scores[order])]
        self._waiting[item] = len(order)
        if len(order) == self.k:
            self.threshold[item] = max(self.threshold[item], int(scores[order[-1]]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for item in list(self._found):
            self._settle(item)
            ids, scores = self._found[item][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"]
            )


_FOUND = "item int, doc_id long, score long"


def seeded(weighted: DataFrame, asked: Asked, seeds: list[np.ndarray], k: int) -> DataFrame:
    """The best documents of each item among those with one of its seed terms."""
    shared = weighted.sparkSession.sparkContext.broadcast((asked, seeds))  # vectors of ITEMS_AT_ONCE items

    def of_batches(batches):
        asked, seeds = shared.value
        best, weight = Best(k, [1] * len(seeds)), np.zeros(asked.n_coordinates, np.int64)
        by_term: dict[int, list[int]] = {}
        for item, terms in enumerate(seeds):
            for t in terms.tolist():
                by_term.setdefault(t, []).append(item)
        for batch in batches:
            held = Vectors(batch)
            rows_of: dict[int, list[np.ndarray]] = {}
            for t, rows in _postings(held, by_term):
                for item in by_term[t]:
                    rows_of.setdefault(item, []).append(rows)
            for item, rows in rows_of.items():
                rows = np.unique(np.concatenate(rows))
                weight[asked.terms[item]] = asked.weights[item]
                best.add(item, held.ids[rows], _products(*held.some(rows), weight))
                weight[asked.terms[item]] = 0
        yield from best.rows()

    return weighted.mapInArrow(of_batches, _FOUND)


def _postings(held: Vectors, wanted: dict[int, object]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch by wanted term."""
    row = np.repeat(np.arange(len(held.ids)), np.diff(held.bounds))
    order = np.argsort(held.terms, kind="stable")
    terms, first = np.unique(held.terms[order], return_index=True)
    for t, a, b in zip(terms.tolist(), first.tolist(), [*first.tolist()[1:], len(order)]):
        if t in wanted:
            yield t, row[order[a:b]]


def lists(weighted: DataFrame, asked: Asked, chunks: np.ndarray) -> DataFrame:
    """A row for each document and essential term of it: ``term``, ``chunk``, ``doc_id``, and the coordinates that the askers have."""
    shared = weighted.sparkSession.sparkContext.broadcast((asked, chunks))

    def of_batches(batches):
        asked, chunks = shared.value
        wanted = np.zeros(asked.n_coordinates, bool)
        for number, batch in enumerate(batches):
            held = Vectors(batch)
            for t, rows in _postings(held, asked.askers):
                starts, terms, impacts = held.some(rows)
                wanted[asked.coordinates[t]] = True
                kept = wanted[terms]
                wanted[asked.coordinates[t]] = False
                bounds = np.concatenate(([0], np.cumsum(kept)))[starts].astype(np.int32)
                # any deal does: rows of a task go round the chunks
                chunk = ((rows * 0x9E3779B1 + number * 0x85EBCA6B + t) >> 7) % chunks[t]
                columns = [pa.array(np.full(len(rows), t, np.int32)), pa.array(chunk.astype(np.int32)), pa.array(held.ids[rows])]
                columns += [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[kept])) for x in (terms, impacts)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "chunk", "doc_id", "terms", "impacts"])

    return weighted.mapInArrow(of_batches, "term int, chunk int, doc_id long, terms array<int>, impacts array<int>")


_INDEX = "term int, block int, ids array<long>, bounds array<int>, terms array<int>, impacts array<int>, summary_terms array<int>, summary array<int>"


def blocked(chunk: pa.Table) -> pa.Table:
    """The documents of a chunk of a posting list clustered into blocks, each with its summary."""
    held = Vectors(chunk.combine_chunks().to_batches()[0])
    term, n = chunk.column("term")[0].as_py(), len(held.ids)
    # the same blocks whatever order the rows come in
    order = np.lexsort((held.impacts[np.minimum(held.bounds[:-1], max(0, len(held.impacts) - 1))], held.ids))
    starts, terms, impacts = held.some(order)
    coordinates, place = np.unique(terms, return_inverse=True)
    dense = np.zeros((n, len(coordinates)), np.float32)
    dense[np.repeat(np.arange(n), np.diff(starts)), place] = impacts
    length = np.sqrt((dense**2).sum(axis=1, keepdims=True))
    unit = dense / np.where(length > 0, length, 1)
    middles = np.arange(0, n, BLOCK)
    block = (unit @ unit[middles].T).argmax(axis=1)
    by_block = np.argsort(block, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(block[by_block]) > 0)))
    most = np.maximum.reduceat(dense[by_block], first, axis=0).astype(np.int32)  # impacts are below 2 ** 24
    rows = []
    for k, (a, b) in enumerate(zip(first.tolist(), [*first.tolist()[1:], n])):
        bounds, own, values = taken(starts, terms, impacts, by_block[a:b])
        there = np.flatnonzero(most[k])
        rows.append((term, k, held.ids[order][by_block[a:b]], bounds.astype(np.int32), own, values, coordinates[there], most[k][there]))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.Table.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)], names)


def answered(index: DataFrame, asked: Asked, k: int) -> DataFrame:
    """The best documents of each item, as far as a task sees; blocks whose summary can't reach the threshold are skipped."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def of_batches(batches):
        asked = shared.value
        best = Best(k, asked.threshold)
        weight, rank = np.zeros(asked.n_coordinates, np.int64), np.full(asked.n_coordinates, _NO_ID)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c.split()[0])) for c in _INDEX.split(", ")]
            by_term: dict[int, list[int]] = {}
            for row, t in enumerate(columns[0].to_pylist()):
                by_term.setdefault(t, []).append(row)
            for t, rows in by_term.items():
                parts = [[np.asarray(columns[c][row].values) for c in range(2, 8)] for row in rows]
                for item in asked.askers[t]:
                    weight[asked.terms[item]] = asked.weights[item]
                    rank[asked.essential[item]] = np.arange(len(asked.essential[item]))
                    for ids, bounds, terms, impacts, where, most in parts:
                        if int((weight[where] * most.astype(np.int64)).sum()) < best.threshold[item]:
                            continue
                        first = np.minimum.reduceat(rank[terms], bounds[:-1]) == rank[t]
                        best.add(item, ids[first], _products(bounds, terms, impacts, weight)[first])
                    weight[asked.terms[item]] = 0
                    rank[asked.essential[item]] = _NO_ID
        yield from best.rows()

    return index.mapInArrow(of_batches, _FOUND)


def _kept(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def essential_terms(terms: np.ndarray, bounds: np.ndarray, df: np.ndarray, threshold: int) -> np.ndarray:
    """Terms to look up, rarest first: all but the commonest whose bounds together stay below the threshold."""
    left, needed = threshold - 1, []
    for at in np.lexsort((terms, -df)).tolist():
        if bounds[at] <= left:
            left -= int(bounds[at])
        else:
            needed.append(at)
    return terms[needed[::-1]]


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = BEST) -> DataFrame:
    """The ``k`` best rows of ``df`` for each item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score`` above 0.

    Equal scores rank by ascending id, null ids last.  Texts of any length are read whole; null
    and empty ones, and texts without terms, don't count as documents.  Items with no term
    that a document has give no rows, repeated items are answered each for itself, repeated
    documents rank each for itself, an empty table gives an empty result, and other columns are ignored.
    Items are answered some ``ITEMS_AT_ONCE`` at a time, by their hash.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), body(item_text_col).alias("text"))
    n_blocks = max(1, -(-asked.count() // ITEMS_AT_ONCE))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))))
    parts = [_searched(df, asked.where(F.col("block") == b).drop("block"), id_col, text_col, k) for b in range(n_blocks)]
    return reduce(DataFrame.unionByName, parts)


def _searched(df: DataFrame, items: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = df.sparkSession
    rows = items.sort("item_id", "text").collect()  # about ITEMS_AT_ONCE of the stated queries
    counts = [Counter(terms_of(r.text)) for r in rows]
    vocabulary = sorted(set().union(*counts))
    folder = f"{checkpoint_root(spark)}/vectors-{uuid4().hex}"
    vectors(df, vocabulary, id_col, text_col).write.parquet(folder)
    held = spark.read.parquet(folder)
    n_documents, n_terms = held.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    m = F.expr(f"75L + (25L * n * {n_documents}L) div {max(1, n_terms)}L")
    share = F.zip_with("tfs", F.array_repeat(m, F.size("tfs")), lambda tf, m: F.call_function("div", 1_000_000_000 * tf.cast("long"), 1000 * tf.cast("long") + 12 * m).cast("int"))
    weighted = held.where("size(terms) > 0").select("doc_id", "terms", share.alias("impacts"))
    named = weighted.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).groupBy("p.terms").agg(F.count(F.lit(1)).alias("df"), F.max("p.impacts").alias("most"))
    df_of, most = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for r in named.collect():  # a row a term of the items
        df_of[r.terms], most[r.terms] = r.df, r.most
    weight = [floor(1000 * log((2 * n_documents + 2) / (2 * int(d) + 1))) for d in df_of]

    number = {t: i for i, t in enumerate(vocabulary)}
    terms, weights, seeds = [], [], []
    for held_terms in counts:
        own = np.array(sorted(number[t] for t in held_terms if weight[number[t]] > 0 and df_of[number[t]] > 0), np.int64)
        terms.append(own)
        weights.append(np.array([held_terms[vocabulary[t]] * weight[t] for t in own], np.int64))
        rarest = own[np.lexsort((own, df_of[own]))]
        seeds.append(rarest[: 1 + int(np.searchsorted(np.cumsum(df_of[rarest]), SEEDS * k))])
    start = Asked(terms, weights, n_coordinates=len(vocabulary))
    found = _kept(seeded(weighted, start, seeds, k), k).where(F.col("rank") == k).select("item", "score").collect()
    threshold = [1] * len(rows)
    for r in found:  # a row an item
        threshold[r.item] = r.score
    essential = [essential_terms(t, w * most[t], df_of[t], least) for t, w, least in zip(terms, weights, threshold)]
    full = Asked(terms, weights, essential, threshold, len(vocabulary))

    chunks = np.maximum(1, -(-df_of // CHUNK))
    index = f"{checkpoint_root(spark)}/blocks-{uuid4().hex}"
    lists(weighted, full, chunks).groupBy("term", "chunk").applyInArrow(blocked, _INDEX).write.parquet(index)
    best = cut(_kept(answered(spark.read.schema(_INDEX).parquet(index), full, k), k))
    ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # ids of ITEMS_AT_ONCE items

