"""Words of whole texts, as arrays of hashes or of exact numbers, for the operators on words.

A word is a run of bytes other than space and 0x09-0x0D in the UTF-8 text. All work
is NumPy over the bytes of many texts at once.

Hashes are made by rounds of multiplications and shifts that mix eight bytes of a word
at a time, and of a range of words by mixing the hashes of its halves. No step is linear in
the one before, unlike in polynomial hashes, whose collisions for one base are collisions for
others. So hashes of two seeds are independent, and 128 bits of them set ranges apart. A word of
over ``LONG_WORD`` bytes is hashed by BLAKE2b instead, so that memory stays bounded by the text.

``numbers`` compares bytes, not hashes: equal words of a batch, and those only, have
one number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from starloom.llm._workers import column_bytes

LONG_WORD = 1 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Seeded 64-bit hashes of words, and of ranges of a sequence of hashes."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.salt, self.left, self.right = rng.integers(0, 1 << 64, 3, np.uint64) | np.uint64(1)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of pairs, in their order."""
        x = a * self.left
        x ^= x >> np.uint64(32)
        x += b
        x *= self.right
        x ^= x >> np.uint64(29)
        x *= self.left
        x ^= x >> np.uint64(32)
        return x

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        """The hash of values[i : i + length] for each i."""
        if len(values) < length:
            return np.zeros(0, np.uint64)
        size, spans = 1, mix(values ^ self.salt)
        while 2 * size <= length:
            spans = self.join(spans[:-size], spans[size:])
            size *= 2
        if size < length:  # two halves that overlap cover the rest
            over = length - size
            spans = self.join(spans[:-over], spans[over:])
        return spans

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of data[a:b] for each a, b."""
        size = ends - starts
        out = mix(size.astype(np.uint64) ^ self.salt)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        for k in range(0, LONG_WORD, 8):
            if not len(live):
                break
            part = np.ascontiguousarray(eights[starts[live] + k]).view("<u8").ravel()
            rest = size[live] - k
            short = rest < 8
            part[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
            out[live] = mix(out[live] * self.right ^ part)
            live = live[rest > 8]
        salt = int(self.salt).to_bytes(8, "little")
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=salt).digest(), "little")
        return out


@dataclass
class Words:
    """``starts``/``ends``: byte ranges of words in ``data``; ``first``: of text k, words first[k]:first[k+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, hasher: Hasher, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash for each word; ``fold`` maps bytes first (lower-casing)."""
        return hasher.words(self.data if fold is None else fold[self.data], self.starts, self.ends)

    def numbers(self, fold: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """For each word the number of its bytes among the distinct words, and how many there are."""
        data = self.data if fold is None else fold[self.data]
        sizes = self.ends - self.starts
        edges = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~_SPACE[self.data]
        kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        column = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(data[inside])]).dictionary_encode()
        return column.indices.to_numpy().astype(np.int64), len(column.dictionary)

    def doc_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(column: pa.Array) -> Words:
    """Words of a string column without nulls."""
    data, offsets = column_bytes(column)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first_bytes, last_bytes = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offsets, first_bytes, last_bytes, np.searchsorted(first_bytes, offsets))
