"""Token ids of whole texts by the tokenizers library, with a memo of text cuts.

A byte-level BPE never merges across its pre-tokens. Some of the places between
pre-tokens can be told without its pattern: before a single space that precedes a
non-space character, around longer runs of white space, and between an ASCII letter or
digit and a following ASCII character that is neither those, an underscore nor space. A
text may be cut there, and the ids of the cuts, put together, are the ids of the
text. Cuts repeat all the time: the distinct ones of a slice are found by Arrow, which
compares their bytes, and each is encoded once.

All cuts go through the whole tokenizer. Texts with characters that regular expression engines may or may not call white space, and those
that hold white space beyond ASCII, are one cut.

A worker's memo holds cuts of at most ``LONG_CUT`` bytes, and ``MEMO_ENTRIES`` of them
besides those of the current slice, so its memory is bounded whatever the texts are. When it is
full, cuts that few slices had are dropped.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from starloom.llm._workers import column_bytes, only

MEMO_ENTRIES, LONG_CUT = 300_000, 64
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 2_500_000

#: Single pre-tokens: letters (up to U+024F), with at most a space before them.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+").fullmatch
#: The public byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on. Line feeds are left as they are.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN) if b != 10}

#: Bits of a byte's class.
_BLANK, _WHITE, _WORD, _MARK, _ODD = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = _MARK
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _WORD
_CLASS[ord("_")] = 0
_CLASS[9:14] = _WHITE
_CLASS[32] = _BLANK | _WHITE
_CLASS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _ODD
#: White space beyond ASCII and characters about which engines disagree, by their UTF-8 bytes.
_DISPUTED = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")


def cut_starts(data: np.ndarray, offsets: np.ndarray, added: Sequence[bytes] = ()) -> np.ndarray:
    """Where cuts of the texts ``data[offsets[k]:offsets[k + 1]]`` start; none spans two texts.

    Texts that hold one of ``added`` aren't cut.
    """
    kind = _CLASS[data]
    first = offsets[:-1][np.diff(offsets) > 0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    white = (kind & _WHITE) > 0
    starts = np.zeros(len(data), bool)
    if len(data) > 1:
        here, before = white[1:], white[:-1]
        ends_run = np.ones(len(here), bool)  # the next byte is no white space and of the same text
        ends_run[:-1] = ~white[2:] & ~edge[2:-1]
        ends_run[-1] = False
        starts[1:] = here & (~before | ends_run)
        starts[1:] |= ~here & before & ((kind[:-1] & _BLANK) == 0)
        starts[1:] |= ((kind[1:] & _MARK) > 0) & ((kind[:-1] & _WORD) > 0)
    raw = memoryview(np.ascontiguousarray(data))
    odd = np.flatnonzero(kind & _ODD)
    for k in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
        low, high = offsets[k : k + 2].tolist()
        if _DISPUTED.search(raw[low:high]):
            starts[low:high] = False
    for token in added:
        for found in re.finditer(re.escape(token), raw):
            k = int(np.searchsorted(offsets, found.start(), "right")) - 1
            starts[offsets[k] : offsets[k + 1]] = False
    starts[first] = True
    return np.flatnonzero(starts)


class MemoEncoder:
    """Ids of the texts of a column, as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.pool, self.sizes, self.places = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slices = np.zeros(0, np.int32)  # in how many slices each was

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _ids(self, cuts: Sequence[bytes]) -> list[bytes]:
        """Ids of each cut, as little-endian unsigned 32-bit numbers."""
        out = [b""] * len(cuts)
        single = [k for k, c in enumerate(cuts) if _LETTERS(c)]
        spelled = b"\n".join([cuts[k] for k in single]).decode("latin-1").translate(_ALPHABET).split("\n") if single else []
        for k, found in zip(single, map(self.model.tokenize, spelled), strict=True):
            out[k] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        other = [k for k, ids in enumerate(out) if not ids]
        for k, ids in zip(other, self.whole([cuts[k].decode() for k in other]), strict=True):
            out[k] = ids
        return out

    def _add(self, ids: list[bytes]) -> None:
        """Append the ids of some cuts to the pool."""
        new = np.array([len(x) // 4 for x in ids], np.int64)
        self.places = np.concatenate([self.places, len(self.pool) + np.cumsum(new) - new])
        self.sizes = np.concatenate([self.sizes, new])
        self.slices = np.concatenate([self.slices, np.ones(len(new), np.int32)])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])

    def _forget(self, needed: np.ndarray) -> np.ndarray:
        """Drop cuts that few slices had, so that half of the room is free, but none that is needed; where the others are now."""
        least = np.partition(self.slices, len(self.slices) - MEMO_ENTRIES // 2)[len(self.slices) - MEMO_ENTRIES // 2]
        stays = self.slices > least
        stays[needed] = True
        kept = np.flatnonzero(stays)
        where = np.full(len(stays), -1)
        where[kept] = np.arange(len(kept))
        words = list(self.memo)  # in the order of their codes
        slices = self.slices[kept] >> 1
        ids = [self.pool[a : a + n].tobytes() for a, n in zip(self.places[kept].tolist(), self.sizes[kept].tolist(), strict=True)]
        self._empty()
        self._add(ids)
        self.slices = slices
        self.memo = {words[k]: j for j, k in enumerate(kept.tolist())}
        return where

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more for the end)."""
        data, offsets = column_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = cut_starts(data, offsets, self.added)
        edges = np.append(starts, len(data)).astype(np.int64)
        kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        cuts = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        raw, where = column_bytes(cuts.dictionary)
        raw, where = raw.tobytes(), where.tolist()
        distinct = [raw[a:b] for a, b in itertools.pairwise(where)]
        codes = np.fromiter(map(self.memo.get, distinct, [-1] * len(distinct)), np.int64, len(distinct))
        known = codes[codes >= 0]
        self.slices[known] += 1
        if len(self.memo) > MEMO_ENTRIES:
            where = self._forget(known)
            codes = np.where(codes >= 0, where[codes], -1)
        missing = np.flatnonzero(codes < 0)
        held = len(self.sizes)
        if len(missing):
            words = [distinct[k] for k in missing.tolist()]
            codes[missing] = held + np.arange(len(words))
            places, sizes, pool, slices = self.places, self.sizes, self.pool, self.slices
            self._add(self._ids(words))
            if max(map(len, words)) <= LONG_CUT:
                self.memo.update(zip(words, codes[missing].tolist(), strict=True))
        picked = codes[cuts.indices.to_numpy()]
        sizes_of = self.sizes[picked]
        ends = np.cumsum(sizes_of)
        ids = self.pool[np.repeat(self.places[picked] - (ends - sizes_of), sizes_of) + np.arange(ends[-1])]
        if len(missing) and max(map(len, words)) > LONG_CUT:  # long ones are not kept
            short = [j for j, w in enumerate(words) if len(w) <= LONG_CUT]
            kept = [self.pool[a : a + n].tobytes() for a, n in zip(self.places[held:][short].tolist(), self.sizes[held:][short].tolist(), strict=True)]
            self.places, self.sizes, self.pool, self.slices = places, sizes, pool, slices
            self._add(kept)
            self.memo.update((words[j], held + i) for i, j in enumerate(short))
        total = np.concatenate([[0], ends])
        return ids, total[np.searchsorted(starts, offsets)]


def encoder(path: str) -> MemoEncoder:
    return only(("tokens", path), lambda: MemoEncoder(path))
