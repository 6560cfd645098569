"""Byte-level BPE from a file of ranks, with token ids and bytes as numpy arrays."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np

# Fixed value: the pattern that divides a text before byte pairs are merged, as the ranks were made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Ranks:
    """Ranks of byte strings, and control strings that follow them in the numbering."""

    of: dict[bytes, int]
    special: tuple[str, ...] = ()


def load_ranks(path: str, special: tuple[str, ...] = ()) -> Ranks:
    """Ranks of a file with a base-64 string and a number a line."""
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}, special)


class Encoder:
    """Encoder and decoder of ranks; control strings are single tokens."""

    def __init__(self, ranks: Ranks):
        import tiktoken

        first = max(ranks.of.values(), default=-1) + 1
        special = {s: first + k for k, s in enumerate(ranks.special)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks.of, special_tokens=special)
        self._special = set(special)
        table = [b""] * (first + len(special))
        for token, rank in ranks.of.items():
            table[rank] = token
        for token, rank in special.items():
            table[rank] = token.encode()
        self.sizes = np.array([len(t) for t in table], np.int64)
        self._starts = np.cumsum(self.sizes) - self.sizes
        self._data = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        """Tokens of a text whose control strings are tokens of their own."""
        return self._encoding.encode_to_numpy(text, allowed_special=self._special, disallowed_special=()).astype(np.int32)

    def encode_plain(self, text: str) -> np.ndarray:
        """Tokens of a text whose control strings, if it has any, are text like any other."""
        return self._encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        at = np.repeat(self._starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self._data[at].tobytes().decode("utf-8")


_ready: list[tuple[Ranks, Encoder]] = []


def encoder(ranks: Ranks) -> Encoder:
    """The encoder of a worker process, which stays from task to task."""
    if not _ready or _ready[0][0] is not ranks:
        _ready[:] = [(ranks, Encoder(ranks))]
    return _ready[0][1]
