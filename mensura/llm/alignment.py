"""Alignment of the tokens of two tokenizers by pointer jumping, and links counted over the corpus.

Both token sequences of a text cover the same bytes.  Every token points to the token
farthest to the right that it overlaps: one of the other tokenizer, or itself where both end
at the same byte.  Doubling the pointers, ``p = p[p]``, for a batch of texts at once leads
every token to the last one of its group, whose number labels the group.

Links are the pairs of tokens of a group.  A text keeps each pair of ids that it holds
linked once, with its number of links, so that counting documents is counting pairs.  The
counts are handed back to the texts in blocks of a bounded number of pairs, so that no
broadcast grows with the data; the sums of the blocks add up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.byte_pairs import PATTERN
from mensura.llm.common import body, checkpoint_root, cut

BYTES_AT_ONCE = 1 << 20
LINKS_AT_ONCE = 1 << 21
PAIRS_AT_ONCE = 1 << 20  # 25 MB as three columns


def byte_letters() -> dict[str, int]:
    """The letter for each byte in the vocabulary of a byte-level tokenizer: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Files:
    """A byte-level BPE file and a SentencePiece model, read on the driver: of the size of the vocabularies."""

    byte_level: str
    pieces: bytes

    @staticmethod
    def load(byte_level_path: str, pieces_path: str) -> Files:
        with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            return Files(a.read(), b.read())

    @cached_property
    def byte_level_tokens(self) -> list[bytes]:
        letters = byte_letters()
        stated = json.loads(self.byte_level)
        named = {i: bytes(letters[c] for c in t) for t, i in stated["model"]["vocab"].items()}
        named |= {t["id"]: t["content"].encode() for t in stated["added_tokens"]}
        return [named.get(i, b"") for i in range(max(named) + 1)]

    @cached_property
    def piece_tokens(self) -> list[bytes]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def check(self) -> Files:
        """Raises if the byte-level file isn't one whose ids are its merge ranks."""
        stated = json.loads(self.byte_level)
        vocabulary, merges = stated["model"]["vocab"], stated["model"]["merges"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        kind = stated["pre_tokenizer"]
        if made != sorted(made) or kind["type"] != "ByteLevel" or not kind.get("use_regex", True) or stated["normalizer"]:
            raise ValueError("the vocabulary must be byte-level BPE, numbered in the order of its merges")
        return self


class Tokens:
    """Both tokenizers in a worker process.

    The byte-level vocabulary is numbered in the order of its merges, so that its ids are
    the ranks by which pairs are merged.
    """

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        table = files.byte_level_tokens
        special = {t["id"] for t in json.loads(files.byte_level)["added_tokens"]}
        ranks = {t: i for i, t in enumerate(table) if t and i not in special}
        self._bytes = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        self.tables = (table, files.piece_tokens)
        self.sizes = tuple(np.array([len(t) for t in table], np.int64) for table in self.tables)
        # an id and what follows it, for the layout of groups
        self.marked = [f"{i}{mark}" for table, marks in zip(self.tables, (",|", ",;")) for mark in marks for i in range(len(table))]

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for a space and each text, or nothing if it is empty or either's bytes are not those."""
        asked = [k for k, t in enumerate(texts) if t]
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        for k, right in zip(asked, self._pieces.encode([texts[k] for k in asked], num_threads=1) if asked else ()):
            whole = " " + texts[k]
            if b"".join(map(self.tables[1].__getitem__, right)) == whole.encode():
                left = self._bytes.encode_to_numpy(whole, allowed_special=set(), disallowed_special=())
                found[k] = left.astype(np.int32), np.array(right, np.int32)
        return found


_ready: list[tuple[Files, Tokens]] = []


def _tokens(files: Files) -> Tokens:
    """The tokenizers of a worker process, which stay from task to task."""
    if not _ready or _ready[0][0].pieces != files.pieces or _ready[0][0].byte_level != files.byte_level:
        _ready[:] = [(files, Tokens(files))]
    return _ready[0][1]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 in order, of tokens with the given byte ends; both sequences cover the same bytes."""
    if not len(ends_a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(ends_a)
    # tokens of a are numbered first; a points to the b that holds its last byte
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    ends = ends_a[to_a] == ends_b
    farthest = np.concatenate([n + to_b, np.where(ends, n + np.arange(len(ends_b)), to_a)])
    while True:
        further = farthest[farthest]
        if (further == farthest).all():
            break
        farthest = further
    label = np.cumsum(ends) - 1  # the last token of a group is a b that ends with an a
    group = label[farthest - n]
    return group[:n], group[n:]


def linked_pairs(texts: np.ndarray, groups: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair of ids as ``a * width + b`` and number of links, for each pair that a text holds linked.

    ``texts`` has the text of each group, ascending.  Links are laid out a bounded number at
    a time; of equal tokens of a group only one is laid out, with their number.
    """
    sides = []
    for group, token in zip(groups, ids):
        key, count = np.unique(group * (1 << 32) + token, return_counts=True)
        sides.append((key >> 32, key & 0xFFFFFFFF, count))
    (ga, a, na), (gb, b, nb) = sides
    first, last = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    reps = last - first
    ends = np.cumsum(reps)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
        r = reps[at:to]
        from_a = np.repeat(np.arange(at, to), r)
        from_b = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + np.repeat(first[at:to], r)
        text, pair = texts[ga[from_a]], a[from_a] * width + b[from_b]
        order = np.lexsort((pair, text))
        text, pair, n = text[order], pair[order], (na[from_a] * nb[from_b])[order]
        starts = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])))) if len(text) else np.empty(0, np.int64)
        out.append((text[starts], pair[starts], np.add.reduceat(n, starts) if len(starts) else n))
        at = to
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    text, pair, n = map(np.concatenate, zip(*out))
    if len(out) > 1:  # a text may reach over several
        order = np.lexsort((pair, text))
        text, pair, n = text[order], pair[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))))
        text, pair, n = text[starts], pair[starts], np.add.reduceat(n, starts)
    return text, pair, n


def _layout(ids: list[np.ndarray], groups: tuple[np.ndarray, np.ndarray], counts: list[np.ndarray], widths: tuple[int, int]) -> np.ndarray:
    """The order of ``a1,a2|b1;a3|b2`` as numbers of strings of an id and the mark after it."""
    out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    before_a, before_b = (np.cumsum(c) - c for c in counts)
    for side, shift in ((0, before_b), (1, before_a + counts[0])):
        last = np.concatenate((groups[side][1:] != groups[side][:-1], [True])) if len(ids[side]) else np.empty(0, bool)
        out[np.arange(len(ids[side])) + shift[groups[side]]] = ids[side] + widths[side] * last + (2 * widths[0] if side else 0)
    return out


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded total size; a larger row is alone."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield at, to
        at = to


def aligned(df: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, groups and links of every row's whole text.

    Returns ``doc_id``, the counts ``n_a``, ``n_b``, ``n_groups``, ``n_links``, in ``groups_sha256``
    a digest of the groups, and in ``pairs`` each pair of ids that is linked, the first times
    the size of the second vocabulary plus the second, and in ``times`` its number of links.

    The text is encoded with a space before it, which the piece model adds itself, special
    tokens' strings as plain text.  A null or empty text, or one that either tokenizer
    doesn't give back byte by byte, has no tokens, zeros and an empty digest.
    """
    shared = df.sparkSession.sparkContext.broadcast(Files.load(byte_level_path, pieces_path).check())  # bounded by the vocabularies

    def of_batches(batches):
        tokens = _tokens(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for at, to in _slices(np.asarray(pc.binary_length(texts), np.int64)):
                found = tokens.encoded(texts.slice(at, to - at).to_pylist())
                none = np.empty(0, np.int32)
                ids = [[f[side] if f else none for f in found] for side in (0, 1)]
                yield _with_groups(batch.column(0).slice(at, to - at), ids, tokens)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return docs.mapInArrow(of_batches, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def _with_groups(doc_ids: pa.Array, ids: list[list[np.ndarray]], tokens: Tokens) -> pa.RecordBatch:
    flat = [np.concatenate([np.empty(0, np.int32), *side]) for side in ids]
    bounds = [_bounds(side) for side in ids]
    groups = groups_of(*(np.cumsum(s[f]) for s, f in zip(tokens.sizes, flat)))
    n = int(groups[0][-1]) + 1 if len(flat[0]) else 0
    counts = [np.bincount(g, minlength=n) for g in groups]
    # groups before each text: texts end where both end
    at = np.append(groups[0], n)[bounds[0]]
    links = _bounds_of(counts[0] * counts[1])[at]
    laid, both = _layout(flat, groups, counts, tuple(map(len, tokens.tables))), bounds[0] + bounds[1]
    strings = [laid[x:y].tolist() for x, y in zip(both.tolist(), both.tolist()[1:])]
    digests = [hashlib.sha256("".join(map(tokens.marked.__getitem__, x))[:-1].encode()).hexdigest() if x else "" for x in strings]
    text, pair, times = linked_pairs(np.repeat(np.arange(len(ids[0])), np.diff(at)), groups, tuple(flat), len(tokens.tables[1]))
    of_text = pa.array(np.searchsorted(text, np.arange(len(ids[0]) + 1)), pa.int32())
    sums = [pa.array(np.diff(x)) for x in (*bounds, at, links)]
    lists = [pa.ListArray.from_arrays(of_text, pa.array(x, pa.int64())) for x in (pair, times)]
    return pa.RecordBatch.from_arrays(
        [doc_ids, *sums, pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    )


def _bounds(lists: list[np.ndarray]) -> np.ndarray:
    return _bounds_of(np.array([len(x) for x in lists], np.int64))


def _bounds_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def alignment(df: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """Per row of ``df`` its tokens, groups and links, and how common its links are in the corpus.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  A
    pair's count is the number of rows that hold it linked; ``n_best`` are the links whose
    count is the highest of any pair with their first id, ties included, ``count_sum`` the
    counts summed over all links.

    Texts of any length are read whole.  Null and empty texts, and texts that either
    tokenizer doesn't give back, have zeros and an empty digest.  Repeated rows, and rows
    with null ids, count and come back as often as they are there; other columns are ignored
    and an empty table gives an empty result.
    """
    spark = df.sparkSession
    width = len(Files.load(byte_level_path, pieces_path).piece_tokens)
    folder = f"{checkpoint_root(spark)}/aligned-{uuid4().hex}"
    aligned(df, byte_level_path, pieces_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    tokens = spark.read.parquet(folder)

    counts = cut(tokens.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.floor(F.col("pair") / width)))
    of_a = counts.groupBy("a").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("held"))  # a row an id
    before = F.sum("held").over(Window.orderBy("a"))
    blocks = of_a.select("a", "most", F.floor((before - 1) / F.lit(pairs_at_once)).alias("block"))
    table = cut(counts.join(F.broadcast(blocks), "a").select("block", "pair", "n", (F.col("n") == F.col("most")).alias("best")))
    n_blocks = (table.agg(F.max("block")).first()[0] or 0) + 1

    own = tokens.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    parts = None
    for block in range(n_blocks):
        part = _scored(tokens.where("n_links > 0"), table.where(F.col("block") == block))
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return own.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )


def _scored(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` of each row over the pairs of one block of the table."""
    # at most pairs_at_once pairs and those of one id, fewer than the second vocabulary
    held = table.select("pair", "n", "best").sort("pair").toArrow()
    shared = tokens.sparkSession.sparkContext.broadcast(tuple(np.asarray(held[c]) for c in ("pair", "n", "best")))

    def of_batches(batches):
        pairs, counts, best = shared.value
        for batch in batches:
            bounds, pair = np.asarray(batch.column(1).offsets).astype(np.int64), np.asarray(batch.column(1).values)
            times = np.asarray(batch.column(2).values)
            place = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            times = np.where(pairs[place] == pair, times, 0) if len(pairs) else times * 0
            sums = [_bounds_of(times * c[place] if len(pairs) else times)[bounds] for c in (best, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.diff(x)) for x in sums]], ["row", "n_best", "count_sum"])

    return tokens.select("row", "pairs", "times").mapInArrow(of_batches, "row long, n_best long, count_sum long")
