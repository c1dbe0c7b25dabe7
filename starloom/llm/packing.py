"""Best-fit packing of token sequences into training sequences of fixed capacity.

1. Each text becomes token ids and an end id. Longer ones than the capacity are
   cut into pieces of the capacity; only the first piece may be shorter.
2. The pieces are counted by length: at most ``capacity`` numbers, whatever the
   input. From them alone ``plan`` finds how many sequences of which lengths to
   build, by exact-complement hashing: for the largest length left, its gap is
   looked up in an index of the sums of one, two and three lengths. A hit is used
   as often as the counts allow. Only where no sum fits exactly, the longest
   fitting length is put in (best fit), and the gap that is left is looked up again.
3. Pieces of one length are interchangeable, so each piece takes the slot that its
   rank among those of its length points to. Ranks are counted within a partition
   and length and shifted by the counts of the partitions before; no length's
   pieces ever meet in one task.

Defined cases: a null text is empty and holds the end id alone. Repeated rows are
packed each. A null id is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._workers import steps, trimmed
from starloom.llm.tokenizing import ENCODE_BYTES, encoder
from starloom.session import checkpointed

CAPACITY = 2048

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text's ids with the end id. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        for part in steps(batches, 1, ENCODE_BYTES):
            ids, edges = encode(part.column(1))
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            size = np.diff(edges) + 1  # with the end id
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (size - (pieces - 1) * capacity)[doc]  # the first piece's length
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            low, high = edges[doc] + start, edges[doc] + start + length
            last = piece == pieces[doc] - 1
            high -= last  # the end id is not among the ids
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            crcs = [zlib.crc32(end, c) if z else c for c, z in zip(crcs, last.tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).mapInArrow(trimmed(run), _PIECES)


class SumIndex:
    """Counts of lengths, and an index from sums to the single lengths, pairs and triples that make them.

    Pairs stand under their sum, those with the larger member first. Triples are indexed through them:
    under a sum stand the largest members whose complement has a pair. Counts only fall, so what a
    sum has lost stays lost, and a cursor for each sum leaves it behind.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        lengths = np.flatnonzero(self.left)
        small, large = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        keep = (small <= large) & (small + large <= capacity)
        small, large = small[keep], large[keep]
        order = np.lexsort((-large, small + large))
        self.larger = large[order].astype(np.int32)
        self.edges = np.searchsorted((small + large)[order], np.arange(capacity + 2))
        self.at = self.edges[:-1].copy()
        self.has_pair = np.diff(self.edges) > 0
        self.firsts = lengths[::-1].astype(np.int32)
        self.first_at = np.zeros(capacity + 1, np.int64)

    def take(self, length: int, used: dict[int, int]) -> bool:
        return length > 0 and self.left[length] > used.get(length, 0)

    def pair(self, total: int, used: dict[int, int], most: int) -> tuple[int, int] | None:
        """The pair of lengths (larger first, at most ``most``) of that sum whose larger one is largest."""
        if total < 2 or not self.has_pair[total]:
            return None
        at, end = int(self.at[total]), int(self.edges[total + 1])
        dead = True
        for k in range(at, end):
            large = int(self.larger[k])
            small = total - large
            alive = self.left[large] > (large == small) and self.left[small] > 0
            if dead and not alive:
                self.at[total] = k + 1
                self.has_pair[total] = k + 1 < end
            dead = dead and not alive
            if alive and large <= most and self.take(large, used) and self.take(small, {**used, large: used.get(large, 0) + 1}):
                return large, small
        return None

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three lengths in stock that fill the gap."""
        if self.take(gap, used):
            return [gap]
        if two := self.pair(gap, used, gap):
            return list(two)
        moved = True
        for k in range(int(self.first_at[gap]), len(self.firsts)):
            first = int(self.firsts[k])
            if 3 * first < gap:
                break
            live = first <= gap - 2 and self.left[first] > 0 and self.has_pair[gap - first]
            if moved and not live:
                self.first_at[gap] = k + 1
            moved = moved and not live
            if live and self.take(first, used) and (two := self.pair(gap - first, {**used, first: used.get(first, 0) + 1}, first)):
                return [first, *two]
        return None

    def longest(self, gap: int, used: dict[int, int]) -> int:
        for length in np.flatnonzero(self.left[: gap + 1])[::-1]:
            if self.take(int(length), used):
                return int(length)
        return 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(number of sequences, [(length, how many of it in each), ...]), ...]`` that use up the counts."""
    stock = SumIndex(counts, capacity)
    out = []
    for length in sorted(counts, reverse=True):
        while stock.left[length]:
            used, gap = {length: 1}, capacity - length
            while gap:
                fill = stock.exact(gap, used)
                if not fill:
                    best = stock.longest(gap, used)
                    if not best:
                        break
                    fill = [best]
                for x in fill:
                    used[x] = used.get(x, 0) + 1
                    gap -= x
            times = int(min(stock.left[x] // n for x, n in used.items()))
            for x, n in used.items():
                stock.left[x] -= n * times
            out.append((times, sorted(used.items(), reverse=True)))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length, runs of ranks and where they go: ``length, rank_from, rank_to, sequence, each, offset``.

    There are no more runs than two for each count that a pattern exhausts, so a
    bound follows from the capacity alone.
    """
    runs, taken, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for length, n in lengths:
            first = taken.get(length, 0)
            taken[length] = first + times * n
            runs.append((length, first, taken[length], sequence, n, offset))
            offset += length * n
        sequence += times
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, planner: Callable = plan) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces with ``doc_id, piece, length``."""
    spark = pieces.sparkSession
    placed = checkpointed(pieces).withColumn("_part", F.spark_partition_id())
    tally = checkpointed(placed.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    runs = spark.createDataFrame(slots(planner(counts, capacity)), "r_length long, r_from long, r_to long, r_sequence long, r_each long, r_offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = tally.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    local = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = local.join(shifts, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    fits = (F.col("length") == F.col("r_length")) & (F.col("_rank") >= F.col("r_from")) & (F.col("_rank") < F.col("r_to"))
    within = F.col("_rank") - F.col("r_from")
    return ranked.join(F.broadcast(runs), fits).select(
        *pieces.columns,
        (F.col("r_sequence") + F.floor(within / F.col("r_each")).cast("long")).alias("sequence_id"),
        (F.col("r_offset") + within % F.col("r_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack_pieces(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity)
