r"""Chat formatting with a loss mask aligned to tokens by offsets.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a
backslash is doubled, and one is set after the first character of ``<|``, ``<s>``,
``</s>``, ``[INST]`` and ``[/INST]``, so that no control string of this or another common
template is left; dropping each backslash before its character gives the text back.

A conversation is rendered whole and encoded once; the marks are tokens of their own, so
token bounds meet turn bounds and turns are encoded alike wherever a text is cut between
them.  The loss mask comes from binary search of the token offsets, the running sum of the
tokens' bytes, in the sorted spans of the assistant's texts.

Rows are dealt by ranges of conversation and runs of ``TURNS_TOGETHER`` turns, so that a
conversation with a large share of all rows is formatted by several tasks, and read as a
sorted stream.  A conversation that goes on in another range, or has more than
``PART_CHARS`` characters, is given in several parts that end at turn bounds; its tokens,
taken in order, are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.byte_pairs import encoder, load_ranks

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART_CHARS = 1 << 20
TURNS_TOGETHER = 4096
_CONTROL = re.compile(r"([<\[])(?=\||/?s>|/?INST\])")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(r"\1" + r"\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, np.ndarray]:
    """Formatted text of (role, text) turns, and start and end, in bytes, of each text under the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        said = escape(text)
        opening = f"{TURN}{escape(role)}{TEXT}"
        start = at + _size(opening)
        end = start + _size(said)
        if role == loss_role:
            spans.append((start, end))
        parts.append(f"{opening}{said}{END}")
        at = end + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token, by its (start, end), lies in one of the sorted spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 1] > offsets[:, 0])


def _runs(batches, key: int) -> Iterator[tuple[bool, list]]:
    """Rows of one batch that follow each other with an equal key; true if the key goes on from the last run."""
    last: object = batches  # no key
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        begin = 0
        keys = columns[key]
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[begin]:
                yield last == keys[begin] and last is not batches, [c[begin:at] for c in columns]
                last, begin = keys[begin], at


def format_conversations(
    df: DataFrame,
    ranks_path: str,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Format every conversation of ``df``.

    Returns ``conv_id``, ``part`` (a number in the order of a conversation's parts),
    ``formatted``, ``token_ids`` and ``loss_mask``.  Null roles and texts are empty; rows
    without a conversation id form one conversation; null turns come first and equal ones
    go by role and text, so that repeated rows are turns of their own.  A single text of
    any size is one turn of one part.  An empty table gives an empty result, and other
    columns are ignored.  ``ranks_path`` is read by the driver.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path, (TURN, TEXT, END)))  # bounded by the file

    def formatted(batches):
        tokenizer, before = encoder(shared.value), TaskContext.get().partitionId() << 32

        def encoded(done: list[tuple[int | None, int, list]]) -> pa.RecordBatch:
            texts, ids, masks = [], [], []
            for _, _, turns in done:
                text, spans = render(turns, loss_role)
                texts.append(text)
                ids.append(tokenizer.encode(text))
                ends = np.cumsum(tokenizer.sizes[ids[-1]])
                masks.append(loss_mask(np.column_stack((ends - tokenizer.sizes[ids[-1]], ends)), spans))
            bounds = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            arrays = [pa.array([c for c, _, _ in done], pa.int64()), pa.array([before + p for _, p, _ in done], pa.int64()), pa.array(texts, pa.string())]
            arrays += [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(v))) for v in (ids, masks)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "formatted", "token_ids", "loss_mask"])

        done: list[tuple[int | None, int, list]] = []
        conv, part, turns, held, waiting = None, 0, [], 0, 0
        for goes_on, (convs, _, roles, texts) in _runs(batches, 0):
            if not goes_on:
                if turns:
                    done.append((conv, part, turns))
                    waiting += held
                conv, part, turns, held = convs[0], 0, [], 0
            for role, text in zip(roles, texts):
                if turns and held + len(text) > part_chars:
                    done.append((conv, part, turns))
                    waiting += held
                    part, turns, held = part + 1, [], 0
                turns.append((role, text))
                held += len(text) + len(role)
                if waiting > part_chars or len(done) >= 256:
                    yield encoded(done)
                    done, waiting = [], 0
        if turns:
            done.append((conv, part, turns))
        if done:
            yield encoded(done)

    ordered = rows.repartitionByRange("conv_id", F.floor(F.col("turn") / TURNS_TOGETHER)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(formatted, "conv_id long, part long, formatted string, token_ids array<int>, loss_mask array<boolean>")


def read_back(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """Digest every conversation from its formatted text, and its loss text from the masked tokens.

    Returns ``conv_id``, ``n_turns``, ``turns_sha256`` (of role, line feed, text and line
    feed of each turn), ``loss_chars``, ``loss_sha256``, ``formatted_chars`` and ``n_tokens``.
    Parts are read each on its own; only for the digests of their texts they come in order.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(load_ranks(ranks_path, (TURN, TEXT, END)))  # bounded by the file
    counts = ["n_turns", "loss_chars", "formatted_chars", "n_tokens"]

    def read(batches):
        tokenizer = encoder(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for text, ids, mask in zip(*batch.columns[2:]):
                text, ids = str(text), ids.values.to_numpy()
                turns = _TURNS.findall(text)
                under = unescape(tokenizer.decode(ids[mask.values.to_numpy(zero_copy_only=False)]))
                rows.append((len(turns), len(under), len(text), len(ids), "".join([f"{unescape(role)}\n{unescape(said)}\n" for role, said in turns]), under))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["conv_id", "part", *counts, "turns", "loss"])

    def digested(batches):
        rows: list[list] = []
        turns_hash = loss_hash = None

        def close() -> None:
            rows[-1] += [turns_hash.hexdigest(), loss_hash.hexdigest()]

        def made() -> pa.RecordBatch:
            types = [pa.int64()] * 5 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", *counts, "turns_sha256", "loss_sha256"])

        for goes_on, (convs, _, *numbers, turns, loss) in _runs(batches, 0):
            if not goes_on:
                if rows:
                    close()
                if len(rows) >= 1024:
                    yield made()
                    rows = []
                turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                rows.append([convs[0], 0, 0, 0, 0])
            rows[-1][1:] = [n + sum(more) for n, more in zip(rows[-1][1:], numbers)]
            for some, under in zip(turns, loss):
                turns_hash.update(some.encode())
                loss_hash.update(under.encode())
        if rows:
            close()
            yield made()

    numbers = ", ".join(f"{c} long" for c in counts)
    parts = formatted.select("conv_id", "part", "formatted", "token_ids", "loss_mask").mapInArrow(read, f"conv_id long, part long, {numbers}, turns string, loss string")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(digested, f"conv_id long, {numbers}, turns_sha256 string, loss_sha256 string")
