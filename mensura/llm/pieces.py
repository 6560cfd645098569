"""SentencePiece encoding and decoding as a max-plus parallel scan.

The best segmentation of a text is the one whose pieces have the largest sum of scores; of
equal sums the one whose last piece is longest, then the last but one, and so on, as the
library has it.  Texts are cut into chunks, and each chunk is a row of its own:

* A chunk's transfer matrix holds, for each entry and exit state, the best score between
  them; a state is how many characters after the cut the first piece starts.  Matrices are
  combined by the associative max-plus product, within blocks of chunks, then over the
  blocks, into the best scores at every cut.
* From these each chunk tells, for each exit state, the entry state that the rule of ties
  takes.  Such maps are composed from the last chunk to the first.
* Every chunk then knows its first and last place and is segmented on its own.

Scores are integers, so that sums are exact and no cut moves a piece.  A space starts a
piece unless another stands before it, for no piece has a space after another character:
a matrix is an outer sum wherever a chunk has such a place.

A model of kind unigram has its scores in the file.  One of kind BPE has merge ranks
instead, of which no sum means anything; its pieces get the scores of Zipf's law, minus the
logarithm of the rank, and their segmentation is that of a unigram model with these scores,
not that of greedy merging.  Decoding is the same for both.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut

CHUNK_CHARS = 1 << 14
BLOCK_CHUNKS = 64
SCORE_UNIT = 32  # scores are whole multiples of its inverse
FALLBACK_COST = 10  # below the least score of a piece, for a character spelt in bytes
BARRED = -1e8  # pieces of scores below, as runs of spaces in some files, are not used; single characters get the least score
_SPACE = "▁"
_LITERAL = "\udc81"  # stands for U+2581 of the text itself, which goes in bytes; no text holds a lone surrogate
_NONE = -(1 << 60)  # no path; sums of a few stay in 64 bits
_ROWS_AT_ONCE = 64
_CHARS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that segment text, with ids and scores in units, and the ids of the 256 bytes."""

    pieces: dict[str, tuple[int, int]]
    byte_ids: list[int]


def zipf_score(rank: int) -> float:
    return -log(rank + 2)


def load_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a model file; scores of successive whole numbers are taken for merge ranks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found, barred, byte_ids = {}, {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            (found if model.get_score(i) > BARRED else barred)[model.id_to_piece(i)] = (i, model.get_score(i))
    if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in found):
        raise ValueError("a piece has a space after another character")
    if all(s <= 0 and s == int(s) for _, s in found.values()):
        found = {p: (i, zipf_score(int(-s))) for p, (i, s) in found.items()}
    least = min((s for _, s in found.values()), default=0.0)
    found |= {p: (i, least) for p, (i, _) in barred.items() if len(p) == 1}
    return Vocabulary({p: (i, round(s * SCORE_UNIT)) for p, (i, s) in found.items()}, byte_ids)


def prepared(text: str) -> str:
    """The text with a space before it, unless it is empty, and its spaces written as U+2581."""
    return text and _SPACE + text.replace(_SPACE, _LITERAL).replace(" ", _SPACE)


class Segmenter:
    """Best segmentation of prepared text by the scores of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, models

        pieces = vocabulary.pieces
        self.longest = max(map(len, pieces), default=1)
        self.spelt = min((s for _, s in pieces.values()), default=0) - FALLBACK_COST * SCORE_UNIT
        self.pieces = pieces
        # between two cuts the library's unigram model finds the same pieces, by whole scores and the same rule of
        # ties, in runs of characters that are pieces; any other character is a piece spelt in bytes
        self.single = {p for p in pieces if len(p) == 1}
        single = "".join(map(re.escape, self.single))
        self.runs = re.compile(f"[{single}]+|[^{single}]" if single else ".", re.DOTALL).findall
        self.best = Tokenizer(models.Unigram([(p, float(score)) for p, (_, score) in pieces.items()], None, False)).encode_batch_fast
        # by place: pieces, then first bytes of characters that are spelt, then their other bytes
        self.ids = np.array([i for i, _ in pieces.values()] + 2 * vocabulary.byte_ids, np.int32)
        self.scores = np.array([score for _, score in pieces.values()] + [self.spelt] * 256 + [0] * 256)

    @cached_property
    def root(self) -> dict:
        """Pieces as a tree, for chunks whose ends are no cuts: a node is its children by character, if any, and the score of the piece that ends there."""
        root: list = [{}, None]
        for piece, (_, score) in self.pieces.items():
            node = root
            for c in piece:
                if node[0] is None:
                    node[0] = {}
                node = node[0].setdefault(c, [None, None])
            node[1] = score
        return root[0]

    def segment(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """Score and ids of each text, whose ends are cuts."""
        found, group, held = [], [], 0
        for text in texts:  # few characters at once: the library holds many bytes for each piece
            if group and held + len(text) > _CHARS_AT_ONCE:
                found += self._segment(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        return found + self._segment(group)

    def _segment(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        split = [self.runs(t) for t in texts]
        made = iter(self.best([r for runs in split for r in runs if r[0] in self.single], add_special_tokens=False))
        found, first = [], len(self.scores) - 512
        for runs in split:
            places: list[int] = []
            for run in runs:
                if run[0] in self.single:
                    places += next(made).ids
                else:
                    spelt = (_SPACE if run == _LITERAL else run).encode("utf-8", "surrogatepass")
                    places += [first + spelt[0], *(first + 256 + b for b in spelt[1:])]
            at = np.array(places, np.int64)
            found.append((int(self.scores[at].sum()), self.ids[at]))
        return found

    def forward(self, s: str, first: list[int], last: int, end: int) -> tuple[list[int], list[int]]:
        """Best scores at the places up to ``end`` by pieces that start before ``last``, and where the last piece starts.

        ``first`` are the scores at the first places, which a piece from before leads to;
        where it is as good as any that starts here, it is taken, being the longest, and
        the piece starts at -1.
        """
        best, back = [*first, *[_NONE] * (end + 1 - len(first))], [-1] * (end + 1)
        root, spelt, reached = self.root, self.spelt, _NONE // 2
        for at in range(min(last, end)):
            here = best[at]
            if here <= reached:
                continue
            node, to = root.get(s[at]), at + 1
            if (node is None or node[1] is None) and here + spelt > best[to]:
                best[to], back[to] = here + spelt, at
            while node is not None:
                if node[1] is not None and here + node[1] > best[to]:
                    best[to], back[to] = here + node[1], at
                if to == end or node[0] is None:
                    break
                node = node[0].get(s[to])
                to += 1
        return best, back

    def _resets(self, s: str, size: int) -> list[int]:
        """Places of a chunk, past all entry states, where any segmentation has a cut."""
        return [m.start() + 1 for m in re.finditer(f"[^{_SPACE}](?={_SPACE})", s[self.longest - 1 : size])]

    def transfer(self, s: str, size: int) -> np.ndarray:
        """Matrix of a chunk of ``size`` characters, of which ``s`` shows those of the next chunk too that a piece may reach.

        Between the first and the last place where any segmentation has a cut, all paths
        gain the same: that sum is left out, as it moves no maximum.
        """
        width = self.longest
        matrix = np.full((width, width), _NONE, np.int64)
        resets = self._resets(s, size)
        if not resets:
            for i in range(min(width, size + 1)):
                reached = self.forward(s, [_NONE] * i + [0], size, len(s))[0][size:]
                matrix[i, : len(reached)] = reached[:width]
            return matrix
        first, last = (width - 1 + r for r in (resets[0], resets[-1]))
        head = np.array([self.forward(s[:first], [_NONE] * i + [0], first, first)[0][-1] for i in range(width)])
        reached = self.forward(s[last:], [0], size - last, len(s) - last)[0][size - last :]
        tail = np.array(reached[:width] + [_NONE] * (width - len(reached)))
        return np.maximum(head[:, None] + tail[None, :], _NONE)

    def entries(self, s: str, size: int, first: np.ndarray) -> list[int]:
        """For each exit state of a chunk, the entry state of the best path, given the best scores at its entry states."""
        resets = self._resets(s, size)
        end = self.longest - 1 + resets[0] if resets else len(s)
        _, back = self.forward(s[:end], first.tolist(), min(size, end), end)

        def entry(at: int) -> int:
            while back[at] >= 0:
                at = back[at]
            return at

        if resets:
            return [entry(end)] * self.longest
        return [entry(size + k) if size + k <= end else 0 for k in range(self.longest)]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of matrices, or of a vector and a matrix, in which sums are maxima and products sums."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), _NONE)


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(at, _ROWS_AT_ONCE)


def _ordered(table: pa.Table, order: str, name: str) -> tuple[list[int], np.ndarray]:
    table = table.sort_by(order)
    return table[order].to_pylist(), np.array(table[name].to_pylist(), np.int64)


_ready: list[tuple[Vocabulary, Segmenter]] = []


def _segmenter(vocabulary: Vocabulary) -> Segmenter:
    """The segmenter of a worker process, which stays from task to task."""
    if not _ready or _ready[0][0] is not vocabulary:
        _ready[:] = [(vocabulary, Segmenter(vocabulary))]
    return _ready[0][1]


def encode(
    df: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    block_chunks: int = BLOCK_CHUNKS,
) -> DataFrame:
    """Encode every row's whole text.

    Returns a row for each row of ``df``: ``doc_id``, ``n_chunks``, ``score`` and ``ids``,
    which are the same for any ``chunk_chars``.  A null text counts as empty, and an
    empty text has no pieces.  Rows of equal or null ids and repeated
    rows come back each, an empty table gives an empty result, and other columns are
    ignored.  ``model_path`` is read by the driver.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model_path))  # bounded by the model
    width = max(map(len, shared.value.pieces), default=1)
    chunk_chars = max(chunk_chars, width)

    def coded(batch: pa.RecordBatch, keys: int, texts: list[str]) -> pa.RecordBatch:
        """The first columns of a batch with score and ids of its texts."""
        made = _segmenter(shared.value)
        found = made.segment(texts)
        sizes = np.cumsum([0, *(len(i) for _, i in found)])
        ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([i for _, i in found]), pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array([s / SCORE_UNIT for s, _ in found], pa.float64()), ids], [*batch.schema.names[:keys], "score", "ids"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    giant = F.length("text") + 1 >= 2 * chunk_chars

    def whole(batches):
        for batch in _slices(batches):
            yield coded(batch, 1, [prepared(str(t)) for t in batch.column(1)])

    small = docs.where(~giant).mapInArrow(whole, "doc_id long, score double, ids array<int>").select("doc_id", F.lit(1).alias("n_chunks"), "score", "ids")

    # the space before the text belongs to the first chunk, so a chunk starts a character earlier in the text
    count = F.greatest(F.floor((F.length("text") + 1) / chunk_chars), F.lit(1)).cast("int")
    giants = docs.where(giant).select("doc_id", "text", count.alias("n_chunks"), F.monotonically_increasing_id().alias("row"))
    chunks = giants.select("doc_id", "row", "n_chunks", "text", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    last = F.col("chunk") == F.col("n_chunks") - 1
    start = F.col("chunk") * chunk_chars - 1
    size = F.when(last, F.length("text") - start).otherwise(chunk_chars)
    shown = F.when(F.col("chunk") == 0, size + width - 2).otherwise(size + width - 1)
    chunks = cut(
        chunks.select(
            "doc_id", "row", "n_chunks", "chunk", F.floor(F.col("chunk") / block_chunks).cast("int").alias("block"), size.cast("int").alias("size"),
            F.col("text").substr(F.greatest(start, F.lit(0)) + 1, shown.cast("int")).alias("part"),
        ).repartition("row", "chunk")
    )
    if chunks.isEmpty():
        return small

    def prepared_part(chunk: int, part: str) -> str:
        return prepared(part) if chunk == 0 else prepared(part)[1:]

    def matrices_of(batches):
        made = _segmenter(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row, block, chunk, size, part = (c[k].as_py() for c in batch.columns)
                flat = made.transfer(prepared_part(chunk, part), size).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([block], pa.int32()), pa.array([chunk], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], ["row", "block", "chunk", "matrix"])

    matrices = cut(chunks.select("row", "block", "chunk", "size", "part").mapInArrow(matrices_of, "row long, block int, chunk int, matrix array<long>"))

    def product(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, each = _ordered(table, "chunk", "matrix")
        each = each.reshape(-1, width, width)
        total = each[0]
        for m in each[1:]:
            total = max_plus(total, m)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [total.reshape(-1)]], schema=_schema("block", "matrix"))

    def vectors(key: int, order: str, table: pa.Table, first: np.ndarray) -> pa.Table:
        """Best scores at the first cut of each matrix of a row."""
        numbers, each = _ordered(table, order, "matrix")
        found = [first]
        for m in each.reshape(-1, width, width)[:-1]:
            found.append(max_plus(found[-1], m))
        return pa.table([[key] * len(numbers), numbers, found], schema=_schema(order, "vector"))

    def block_vectors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return vectors(key[0].as_py(), "block", table, np.array([0] + [_NONE] * (width - 1), np.int64))

    def chunk_vectors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return vectors(key[0].as_py(), "chunk", table, np.array(table["vector"][0].as_py(), np.int64))

    def _schema(order: str, name: str) -> pa.Schema:
        return pa.schema([("row", pa.int64()), (order, pa.int32()), (name, pa.list_(pa.int64()))])

    blocks = matrices.groupBy("row", "block").applyInArrow(product, "row long, block int, matrix array<long>")
    starts = blocks.groupBy("row").applyInArrow(block_vectors, "row long, block int, vector array<long>")  # a block's matrix for a million characters
    at_cuts = matrices.join(starts, ["row", "block"]).groupBy("row", "block").applyInArrow(chunk_vectors, "row long, chunk int, vector array<long>")

    def maps_of(batches):
        made = _segmenter(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row, chunk, size, part, first = (c[k].as_py() for c in batch.columns)
                entry = made.entries(prepared_part(chunk, part), size, np.array(first, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([chunk], pa.int32()), pa.array([entry], pa.list_(pa.int32()))], ["row", "chunk", "entries"])

    maps = chunks.join(at_cuts, ["row", "chunk"]).select("row", "chunk", "size", "part", "vector").mapInArrow(maps_of, "row long, chunk int, entries array<int>")

    def composed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Entry and exit state of each chunk of a row, from a few numbers a chunk."""
        numbers, each = _ordered(table, "chunk", "entries")
        state, found = 0, []
        for entry in each[::-1]:
            found.append((int(entry[state]), state))
            state = int(entry[state])
        found.reverse()
        return pa.table(
            [[key[0].as_py()] * len(numbers), numbers, [a for a, _ in found], [b for _, b in found]],
            schema=pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())]),
        )

    states = maps.groupBy("row").applyInArrow(composed, "row long, chunk int, entry int, exit int")

    def parts(batches):
        for batch in _slices(batches):
            columns = [c.to_pylist() for c in batch.columns[3:]]
            yield coded(batch, 4, [prepared_part(chunk, part)[entry : size + to] for chunk, size, part, entry, to in zip(*columns)])

    large = (
        chunks.join(states, ["row", "chunk"])
        .select("doc_id", "row", "n_chunks", "chunk", "size", "part", "entry", "exit")
        .mapInArrow(parts, "doc_id long, row long, n_chunks int, chunk int, score double, ids array<int>")
        .groupBy("row")  # the chunks of one text
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_chunks").alias("n_chunks"), F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
        .select("doc_id", "n_chunks", "score", F.flatten("parts.ids").alias("ids"))
    )
    return small.unionByName(large)


def decoder(model_path: str):
    """An Arrow function of a text's ids that gives the text back."""
    vocabulary = load_vocabulary(model_path)
    spelt = {i: p.replace(_SPACE, " ").encode() for p, (i, _) in vocabulary.pieces.items()}
    spelt |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    parts = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes

    def decoded(ids: np.ndarray) -> bytes:
        """Bytes of the pieces, one after the other, without the space before a text."""
        lengths = sizes[ids]
        at = np.repeat(starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        return data[at][1:].tobytes()

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([decoded(i.values.to_numpy()).decode() for i in ids], pa.string())

    return decode
