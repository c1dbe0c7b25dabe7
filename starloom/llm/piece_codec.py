"""SentencePiece encoding with spans in the original bytes, and decoding.

``Normalizer`` does the library's normalisation itself and keeps, for each byte of
the normalised text, where it came from: at each place the longest key of the
compiled character map (a double-array trie) that is a prefix of the rest is
replaced; otherwise one character is taken over. Then white space is collapsed, a
space is put in front and spaces become U+2581, as the model's settings ask. The
library segments the result with a copy of the model whose own normaliser is set
to do nothing, so its ids are those of the library with the whole model. Pieces are
consecutive in the normalised text; their ends are mapped through the alignment to
byte spans of the original. Decoding is the library's.

Defined cases: a null text counts as empty: no ids and an empty decoded text. Repeated
rows and null ids give a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm._workers import only, steps, trimmed

SPACE = "▁"
_MARK = SPACE.encode()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, int, int | bytes]]:
    """Of a protocol buffer message: field number, first and last byte, value."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, start, at, value


class CharacterMap:
    """The compiled map: trie size, double-array units, then replacements ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.replacements = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, node, best = self.units, 0, None
        node ^= self._offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        length, start = best
        return length, self.replacements[start : self.replacements.index(0, start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


def _width(byte: int) -> int:
    return 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Normalizer:
    def __init__(self, compiled: bytes = b"", add_dummy_prefix: bool = True, remove_extra_whitespaces: bool = True, escape_whitespaces: bool = True):
        self.map = CharacterMap(compiled) if compiled else None
        self.prefix, self.squeeze, self.escape = add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text after the character map, and for each byte the first byte of its source; one more for the end."""
        if self.map is None:
            lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
            source = np.maximum.accumulate(np.where(lead, np.arange(len(text)), 0)) if text else np.zeros(0, np.int64)
            return text, np.append(source, len(text))
        out, source, at = bytearray(), [], 0
        while at < len(text):
            found = self.map.longest(text, at)
            length, part = found if found else (n := _width(text[at]), text[at : at + n])
            out += part
            source += [at] * len(part)
            at += length
        return bytes(out), np.array([*source, len(text)])

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and their sources, with one more entry for the end."""
        mapped, source = self._mapped(text)
        data = np.frombuffer(mapped, np.uint8)
        keep = np.ones(len(data), bool)
        blank = data == 0x20
        if self.squeeze:
            keep[1:] = ~(blank[1:] & blank[:-1])
            inside = np.flatnonzero(~blank)
            keep[: inside[0] if inside.size else len(data)] = False
            keep[inside[-1] + 1 if inside.size else 0 :] = False
        data, begin, blank = data[keep], source[:-1][keep], blank[keep]
        end = source[np.flatnonzero(keep)[-1] + 1] if len(begin) else source[-1]
        if not len(data):
            return b"", np.array([len(text)])
        if self.prefix:
            data, begin, blank = np.concatenate([[0x20], data]).astype(np.uint8), np.concatenate([begin[:1], begin]), np.concatenate([[True], blank])
        if self.escape:
            times = np.where(blank, len(_MARK), 1)
            begin = np.repeat(begin, times)
            data = np.repeat(data, times)
            firsts = np.cumsum(times)[blank] - len(_MARK)
            for k, byte in enumerate(_MARK):
                data[firsts + k] = byte
        out, begin = data.tobytes(), np.append(begin, end)
        if self.squeeze:  # the library trims the mark itself, too
            tail = _MARK if self.escape else b" "
            size = len(out)
            while out[:size].endswith(tail):
                size -= len(tail)
            out, begin = out[:size], begin[: size + 1]
        return out, begin


class PieceCodec:
    """A SentencePiece model file: ids, original byte spans, decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        settings: dict[int, int | bytes] = {}
        bare = bytearray()
        pieces: list[bytes] = []
        kinds: list[int] = []
        for number, start, end, value in _fields(model):
            if number == 3:
                settings = {n: v for n, _, _, v in _fields(value)}
                continue
            if number == 1:
                own = {n: v for n, _, _, v in _fields(value)}
                pieces.append(own[1])
                kinds.append(own.get(3, 1))
            bare += model[start:end]
        #: A normaliser that does nothing: field 3, with flags 3, 4 and 5 off.
        bare += b"\x1a\x06\x18\x00\x20\x00\x28\x00"
        self.normalizer = Normalizer(settings.get(2, b""), bool(settings.get(3, 1)), bool(settings.get(4, 1)), bool(settings.get(5, 1)))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=bytes(bare))
        #: Bytes of normalised text that a piece stands for; 0 for unknown pieces, whose length is not fixed.
        self.widths = np.array([1 if k == 6 else 0 if k == 2 else len(p) for p, k in zip(pieces, kinds, strict=True)])

    def encode(self, text: str) -> list[int]:
        return self.segmenter.encode(self.normalizer(text.encode())[0].decode())

    def encode_spans(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and the byte span ``[begin, end)`` in the original text of each."""
        normalised, source = self.normalizer(text.encode())
        ids = self.segmenter.encode(normalised.decode())
        return ids, self._spans(ids, normalised, source)

    def _spans(self, ids: list[int], normalised: bytes, source: np.ndarray) -> np.ndarray:
        widths = self.widths[ids] if ids else np.zeros(0, np.int64)
        if (widths == 0).any():  # unknown pieces cover what their neighbours leave
            proto = self.segmenter.encode(normalised.decode(), return_type="proto")
            widths = np.array([len(p.surface.encode()) for p in proto.pieces])
        ends = np.cumsum(widths)
        return np.stack([source[ends - widths], np.maximum(source[ends], source[ends - widths])], axis=1).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(path: str) -> PieceCodec:
    return only(("pieces", path), lambda: PieceCodec(path))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``doc_id, ids`` and, if asked for, ``begins, ends``: pieces and their original byte spans. No shuffle."""
    schema = "doc_id long, ids array<int>" + ", begins array<long>, ends array<long>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        one = codec(model_path)
        for batch in steps(batches, 1):
            rows = [one.encode_spans(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([ids for ids, _ in rows], pa.list_(pa.int32()))]
            if spans:
                columns += [pa.array([at[:, k] for _, at in rows], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "begins", "ends"][: len(columns)])

    return _texts(docs, id_col, text_col).mapInArrow(trimmed(run), schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes`` of whole texts, encoded and decoded again.

    spanned_bytes: bytes of the original that some piece's span covers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        one = codec(model_path)
        for batch in steps(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                ids, at = one.encode_spans(text)
                covered = int((at[:, 1] - np.maximum(at[:, 0], np.concatenate([[0], at[:-1, 1]]))).clip(0).sum()) if ids else 0
                listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                rows.append((len(ids), listed, hashlib.sha256(one.decode(ids).encode()).hexdigest(), covered))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"])

    return _texts(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
