"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, of the target (texts labelled good) and of the
raw corpus, give every document the logarithm of its likelihood ratio.  The documents are
resampled without replacement in proportion to that weight: Gumbel noise is added to the
log-weights and the ``k`` largest stay.

An n-gram is a run of four bytes, or a pair of neighbouring words in which a repeated word
counts as one common token.  The two kinds have a model each.  A document's log-weight is
the sum of the log-ratios of all its n-grams, of whatever length it is; long texts are
looked at in windows that lose none.  So the longer a text, the surer its weight: a
language or source that few labelled texts are of weighs heavily against long texts, and
labels should number in the thousands.  Log-ratios are kept in fixed point, so that the
weight of a text is the same in every pass, whatever batch it comes in.

The raw model counts all documents.  At most ``max_labels`` labelled rows are used, those
of least hash: one half for the target model, the other for the cut between accepted and
rejected weights, which so is judged by texts that the model hasn't seen.
``k`` is the number of documents over the cut.  The ``k`` largest perturbed weights are
found by radix selection: counts of successive digits, never a sort or a gathered corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut

BUCKETS = 1 << 16
PAIR_BUCKETS = 1 << 12
MAX_LABELS = 20_000
COST_OF_LOST_GOOD = 10
SMOOTHING = 16.0  # added to every bucket of both models
SEED = 17
_UNIT = 1 << 16  # fixed point of log-ratios
_PIECE = 1 << 20  # bytes looked at together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.ones(1, np.uint64)
_POWERS = np.cumprod(np.concatenate((_ONE, np.full(_PIECE, _BASE, np.uint64))), dtype=np.uint64)
_UNPOWERS = np.cumprod(np.concatenate((_ONE, np.full(_PIECE, pow(int(_BASE), -1, 1 << 64), np.uint64))), dtype=np.uint64)

Grams = tuple[np.ndarray, np.ndarray]  # buckets, and the bounds of the rows among them


def _grams_of(texts: pa.Array, piece: int = _PIECE) -> Iterator[tuple[int, Grams, Grams]]:
    """Number of the first row and n-grams of each kind, for runs of rows or windows of a long row."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        begin = bounds[row]
        end = max(row + 1, int(np.searchsorted(bounds, begin + piece, "right")) - 1)
        if bounds[end] - begin <= piece:
            part, within = data[begin : bounds[end]], bounds[row : end + 1] - begin
            words, starts = _words(part, within)
            yield row, _runs(part, within), _pairs(words, np.searchsorted(within, starts, "right"), len(within) - 1)
        else:
            for chars, pairs in _windows(data[begin : bounds[end]], piece):
                yield row, (chars, np.array([0, len(chars)])), (pairs, np.array([0, len(pairs)]))
        row = end


def _runs(data: np.ndarray, bounds: np.ndarray) -> Grams:
    """Buckets of the runs of four bytes within rows."""
    if len(data) < 4:
        return np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    rows, wide = bounds[1:], data.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    inside = np.ones(len(data), bool)
    for back in (1, 2, 3):
        inside[rows[rows >= back] - back] = False
    inside = inside[: len(code)]
    # a row of fewer than four bytes ends before its own first run does
    return ((code * np.uint32(2654435761)) >> 16)[inside].astype(np.int64), np.concatenate(([0], np.cumsum(inside)))[np.minimum(bounds, len(code))]


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, divided by bytes up to 32 and by rows, and where they start."""
    gap, edges = data <= 32, np.isin(np.arange(1, len(data)), bounds[1:-1])
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | edges
    last[:-1] &= gap[1:] | edges
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _POWERS[: len(data)], dtype=np.uint64)))
    return (sums[end] - sums[start]) * _UNPOWERS[start], start


def _pairs(words: np.ndarray, of: np.ndarray, rows: int) -> Grams:
    """Buckets of neighbouring words of a row; ``of`` counts rows from one."""
    pair = np.flatnonzero(of[1:] == of[:-1]) if len(words) > 1 else np.empty(0, np.int64)
    a, b = words[pair], words[pair + 1] if len(pair) else words[:0]
    mixed = ((a * _BASE ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(PAIR_BUCKETS)
    return np.where(a == b, 0, np.maximum(mixed, 1)).astype(np.int64), np.searchsorted(of[pair], np.arange(1, rows + 2))


def _windows(data: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of both kinds in each window of one text; runs and words go on from window to window."""
    complete, held, size = np.empty(0, np.uint64), 0, 0  # the last whole word; hash and length of a word that isn't yet
    for at in range(0, len(data), piece):
        part = data[at : at + piece]
        shown = data[at : at + piece + 3]
        words, starts = _words(part, np.array([0, len(part)]))
        if size and part[0] > 32:  # goes on
            held += pow(int(_BASE), size, 1 << 64) * int(words[0])
            first_end = int(np.argmax(part <= 32)) if (part <= 32).any() else len(part)
            size += first_end
            words, starts = words[1:], starts[1:]
            whole = [] if first_end == len(part) else [held]
        else:
            first_end, whole = 0, [held] if size else []
        if whole or not size:
            complete = np.concatenate((complete[-1:], np.array([h % (1 << 64) for h in whole], np.uint64)))
            held = size = 0
            if len(words) and part[-1] > 32:
                held, size = int(words[-1]), len(part) - int(starts[-1])
                words = words[:-1]
            complete = np.concatenate((complete, words))
        else:
            complete = complete[-1:]
        yield _runs(shown, np.array([0, len(shown)]))[0], _pairs(complete, np.ones(len(complete), np.int64), 1)[0]
    if size:
        complete = np.concatenate((complete[-1:], np.array([held % (1 << 64)], np.uint64)))
        yield np.empty(0, np.int64), _pairs(complete, np.ones(len(complete), np.int64), 1)[0]


def _count(texts: pa.Array, counts: np.ndarray, piece: int = _PIECE) -> None:
    for _, *kinds in _grams_of(texts, piece):
        for kind, (buckets, _) in enumerate(kinds):
            counts[kind] += np.bincount(buckets, minlength=BUCKETS)


def _weigh(texts: pa.Array, ratios: np.ndarray, piece: int = _PIECE) -> np.ndarray:
    total = np.zeros(len(texts), np.int64)
    for row, *kinds in _grams_of(texts, piece):
        for kind, (buckets, at) in enumerate(kinds):
            total[row : row + len(at) - 1] += np.diff(np.concatenate(([0], np.cumsum(ratios[kind][buckets])))[at])
    return total / _UNIT


@dataclass(frozen=True)
class ImportanceModel:
    """Fixed-point log-ratios of target to raw by kind and bucket, and the cut."""

    ratios: np.ndarray
    cut: float

    def log_weight(self, text_col: str | Column) -> Column:
        """Log-weight of a text column; a null text counts as empty and weighs nothing."""
        shared = self.ratios

        @F.arrow_udf("double")
        def weigh(texts: pa.Array) -> pa.Array:
            return pa.array(_weigh(texts, shared))

        return weigh(body(text_col))


def fit_importance(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labels: int = MAX_LABELS,
) -> ImportanceModel:
    """Fit the models on all of ``df`` and on at most ``max_labels`` rows of ``labels``.

    A label above zero marks a good text.  Rows of ``labels`` with null ids or labels and
    ids with contrary labels don't count.  Without a good text the ratios are zero; without
    texts of both kinds nothing is rejected.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("_good"))
        .dropna()
        .groupBy("_id")
        .agg(F.min("_good").alias("_good"), F.max("_good").alias("_other"))
        .where("_good = _other")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labels)
        .select("_id", "_good", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)) == 0).alias("_fit"))
    )
    known = F.broadcast(cut(known))  # at most max_labels rows
    docs = df.select(F.col(id_col).alias("_id"), body(text_col).alias("text")).join(known, "_id", "left")

    def counted(batches):
        counts = np.zeros((2, 2, BUCKETS), np.int64)
        for batch in batches:
            texts = batch.column(0)
            _count(texts, counts[0])
            _count(texts.filter(batch.column(1).fill_null(False)), counts[1])
        flat = counts.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["bucket", "n"])

    table = (
        docs.select("text", (F.col("_good") & F.col("_fit")).alias("_target"))
        .mapInArrow(counted, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most four times BUCKETS rows
    )
    flat = np.zeros(4 * BUCKETS)
    flat[table["bucket"].to_numpy()] = table["n"].to_numpy()
    raw, target = flat.reshape(2, 2, BUCKETS)
    if not target.any():
        return ImportanceModel(np.zeros((2, BUCKETS), np.int64), -np.inf)

    # the raw counts brought to the target's size, so that both are smoothed alike
    scaled = raw * (target.sum(axis=1) / np.maximum(raw.sum(axis=1), 1))[:, None]
    ratios = np.log(target + SMOOTHING) - np.log(scaled + SMOOTHING)
    model = ImportanceModel(np.round(ratios * _UNIT).astype(np.int64), -np.inf)
    seen = docs.where("_good is not null and not _fit").select("_good", model.log_weight("text").alias("w")).toArrow()  # max_labels rows
    return ImportanceModel(model.ratios, _best_cut(seen["w"].to_numpy(), seen["_good"].to_numpy().astype(bool)))


def _best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which to accept, a lost good text costing as much as several bad ones that stay."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    cost = np.concatenate(([0], np.cumsum(good * COST_OF_LOST_GOOD))) + np.concatenate(((~good)[::-1].cumsum()[::-1], [0]))
    best = np.flatnonzero(cost == cost.min())
    edges = np.concatenate(([weights[0] - 1], weights, [weights[-1] + 1]))
    return float((edges[best[0]] + edges[best[0] + 1]) / 2)


def _perturbed(id_col: str, text_col: str, weight: Column, seed: int) -> Column:
    """Log-weight with Gumbel noise from a hash of the row, in fixed point."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), body(text_col), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return F.floor((weight - F.log(-F.log(uniform))) * float(1 << 32)).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The ``k``-th largest of the column ``key``; None if there are fewer rows.

    A pass counts the next 16 bits of the keys that share the digits found so far, and
    brings at most 65,536 counts to the driver.
    """
    found = 0
    for shift in (48, 32, 16, 0):
        counts = keys.groupBy(F.shiftright("key", shift).alias("digit")).count().collect()
        for digit, n in sorted(map(tuple, counts), reverse=True):
            if n >= k:
                found = digit
                break
            k -= n
        else:
            return None
        keys = keys.where(F.shiftright("key", shift) == found)
    return found


def _scored(df: DataFrame, model: ImportanceModel, id_col: str, text_col: str, seed: int) -> DataFrame:
    scored = df.withColumn("log_weight", model.log_weight(text_col))
    return scored.withColumn("sample_key", _perturbed(id_col, text_col, F.col("log_weight"), seed))


def _selected(scores: DataFrame, model: ImportanceModel, k: int | None) -> Column:
    """Whether a row is in the sample, by the scores of all rows."""
    wanted = scores.where(F.col("log_weight") >= model.cut).count() if k is None else k
    edge = kth_largest(scores.select(F.col("sample_key").alias("key")), wanted) if wanted > 0 else None
    return F.lit(wanted > 0) if edge is None else F.col("sample_key") >= edge


def importance_scores(
    df: DataFrame, model: ImportanceModel, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """``doc_id``, ``log_weight``, ``sample_key`` and ``selected`` of every row, as :func:`importance_sample` has them, from one pass."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scores = cut(_scored(docs, model, "doc_id", "text", seed).drop("text"))
    return scores.withColumn("selected", _selected(scores, model, k))


def importance_sample(
    df: DataFrame,
    model: ImportanceModel,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """Rows of ``df`` with ``log_weight`` and ``sample_key``, and whether they are in the sample.

    Without ``k``, as many are taken as have a log-weight over the model's cut.  The noise
    is a hash of id and text: it is the same in each run, and rows that repeat both share
    their fate, so that the sample has more than ``k`` rows where such rows meet its edge.
    Columns of ``df`` keep their names; ``log_weight``, ``sample_key`` and ``selected``
    replace columns of these names.  A null text is empty and has a log-weight of zero, a
    text of any length counts whole, and an empty table gives an empty result.
    """
    scored = _scored(df, model, id_col, text_col, seed)
    return scored.withColumn("selected", _selected(cut(scored.select("log_weight", "sample_key")), model, k))


def drop_low_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that importance resampling accepts; the columns stay as they are, whatever their names.

    Nulls, empty and long texts, ties and empty tables are as in :func:`importance_sample`.
    """
    held = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = importance_sample(held, fit_importance(df, labels, id_col, text_col))
    return chosen.where("selected").select("row.*")
