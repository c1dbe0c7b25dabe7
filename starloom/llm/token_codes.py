"""Token ids in directly addressable codes: a binary format with random access.

An id is split into chunks of ``bits`` bits, low ones first. Level k holds chunk k
of all ids that have one, and a bitmap that says which of them go on in level k+1.
A rank directory counts the set bits before every 512th position, so the place
of an id's next chunk is one lookup and a popcount: any token is read without
decoding a block, and short (frequent) ids take one chunk.

A file image is, little-endian: the magic ``SLTC``, then the 64-bit numbers bits,
levels, documents and tokens; the documents' ids (64-bit), their null flags (one byte)
and their starts (64-bit, one more than documents); then for each level its
number of chunks (64-bit), the chunks (8 or 16 bits each), the bitmap (bytes, lowest
bit first, padded to 64 bytes) and the rank directory (64-bit).

``write`` sorts by document id over range partitions and stores images of about
``shard_tokens`` tokens, in order, as rows of a Parquet table, as Spark's writers
are what reaches any shared store; ``save`` and ``load`` do the same for local files.

Defined cases: null text is empty (the end id alone); null ids come first; rows
with equal ids are ordered by a hash of their text, then by text; an empty table gives no image and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm._workers import lean, steps, trimmed
from starloom.llm.tokenizing import ENCODE_BYTES, encoder

MAGIC, BLOCK = b"SLTC", 512
_CHUNK = {8: "<u1", 16: "<u2"}


def encode_image(doc_ids: Sequence[int | None], ids: Sequence[np.ndarray], bits: int = 8) -> bytes:
    """The file image of documents' token ids."""
    values = np.concatenate(ids).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    levels = []
    rest = values
    while len(rest) or not levels:
        goes_on = rest >> np.uint32(bits) > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK // 8).sum(1)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        chunks = rest.astype(_CHUNK[bits])  # the low bits
        levels.append(np.array([len(rest)], "<u8").tobytes() + chunks.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[goes_on] >> np.uint32(bits)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([bits, len(levels), len(doc_ids), len(values)], "<u8")
    return b"".join([MAGIC, head.tobytes(), numbers.tobytes(), nulls.tobytes(), starts.tobytes(), *levels])


class Image:
    """A reader over a file image; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token code image")
        at = 4

        def read(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.bits, levels, docs, self.n_tokens = map(int, read("<u8", 4))
        numbers, nulls = read("<i8", docs), read("<u1", docs)
        self.doc_ids = [None if null else int(d) for d, null in zip(numbers, nulls, strict=True)]
        self.starts = read("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(read("<u8", 1)[0])
            chunks = read(_CHUNK[self.bits], n)
            blocks = -(-n // BLOCK)
            self.levels.append((chunks, read("<u1", blocks * BLOCK // 8), read("<u8", blocks + 1)))

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        return int(self.tokens(i, i + 1)[0])

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before position i: a directory entry and a popcount within its block."""
        _, bitmap, directory = self.levels[level]
        block, (byte, bit) = i // BLOCK, divmod(i, 8)
        out = int(directory[block]) + int(np.bitwise_count(bitmap[block * BLOCK // 8 : byte]).sum())
        return out + (int(bitmap[byte] & ((1 << bit) - 1)).bit_count() if bit else 0)

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b, as unsigned 32-bit numbers; nothing before or after is decoded.

        The next chunks of neighbours are neighbours, too, so one rank finds those of all.
        """
        if not 0 <= a <= b <= self.n_tokens:
            raise IndexError((a, b))
        out = np.zeros(b - a, "<u4")
        who = np.arange(b - a)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[who] |= chunks[a : a + len(who)].astype("<u4") << np.uint32(k * self.bits)
            goes_on = np.unpackbits(bitmap[a // 8 : -(-(a + len(who)) // 8)], bitorder="little")[a % 8 : a % 8 + len(who)].astype(bool)
            following = who[goes_on]
            if not len(following):
                break
            a, who = self._rank(k, a), following
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, start in this image, ids; each document is read at its own place."""
        for doc, a, b in zip(self.doc_ids, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield doc, a, self.tokens(a, b)


def save(path: str, image: bytes) -> None:
    Path(path).write_bytes(image)


def load(path: str) -> Image:
    return Image(Path(path).read_bytes())


#: Bytes of text for one task of the writer.
TASK_BYTES = 64_000_000


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = 1_000_000, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and store their images under ``path`` in ascending id order.

    Rows are ``part, shard, inside, n_tokens, image``: (part, shard) is the order, inside counts
    the part's ids before. Rows of one id are dealt out by their texts' hash, so an id that many
    rows have (or lack) fills several parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4")
        docs_of: list[int | None] = []
        ids_of: list[np.ndarray] = []
        total = shard = inside = 0

        def image() -> pa.RecordBatch:
            nonlocal docs_of, ids_of, total, shard, inside
            columns = [pa.array([x], pa.int64()) for x in (shard, inside, total)] + [pa.array([encode_image(docs_of, ids_of, bits)], pa.binary())]
            docs_of, ids_of, total, shard, inside = [], [], 0, shard + 1, inside + total
            return pa.RecordBatch.from_arrays(columns, names=["shard", "inside", "n_tokens", "image"])

        for part in steps(batches, 1, ENCODE_BYTES):
            ids, edges = encode(part.column(1))
            for doc, a, b in zip(part.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                docs_of.append(doc)
                ids_of.append(np.concatenate([ids[a:b], end]))
                total += len(ids_of[-1])
                if total >= shard_tokens:
                    yield image()
        if docs_of:
            yield image()

    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES), 1)
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    images = ordered.mapInArrow(trimmed(run), "shard long, inside long, n_tokens long, image binary")
    images.select(F.spark_partition_id().alias("part"), "shard", "inside", "n_tokens", "image").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from stored images; start counts the ids of all documents before.

    Only the number of ids before each part is broadcast: one row for each task of the writer.
    """
    images = spark.read.schema("part int, shard long, inside long, n_tokens long, image binary").parquet(path)
    parts = images.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = images.join(F.broadcast(bases), "part").select((F.col("base") + F.col("inside")).alias("base"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(doc, base + start, len(ids), zlib.crc32(ids)) for doc, start, ids in Image(data.as_py()).documents()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
