"""Connected components of an edge table: each partition's edges are contracted, then large-star and small-star steps alternate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm._workers import lean
from starloom.session import checkpointed


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


#: Edges that are contracted at a time; a bound of memory only.
CHUNK = 1_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges as stars: each node with the smallest node that it reaches by them, but for that node itself."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    waiting: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    size = 0

    def out() -> Iterable[pa.RecordBatch]:
        a, b = contracted(*np.concatenate(waiting, axis=1))
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

    for batch in batches:
        waiting.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= CHUNK:
            yield from out()
            waiting, size = [np.zeros((2, 0), np.int64)], 0
    yield from out()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of undirected ``edges(a, b)`` of longs: the smallest node reachable.

    Each step replaces edges by as many or fewer that point to smaller nodes, and
    keeps connectivity, until only stars are left. Nulls and loops are dropped, edges
    may repeat, and no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    down = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = checkpointed(down.mapInArrow(lean(_stars), "a long, b long").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter(b > a).join(low, "a").select(b.alias("a"), F.col("low").alias("b")).filter("a != b")
        kept = now.select("a").join(low, "a").select("a", F.col("low").alias("b")).filter("a != b")
        stars = large.unionByName(kept).distinct()  # every a > b
        least = stars.groupBy("a").agg(F.min("b").alias("low"))
        small = stars.join(least, "a").select(b.alias("a"), F.col("low").alias("b")).filter("a != b")
        following = checkpointed(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        if (new := _mark(following)) == mark:
            break
        now, mark = following, new
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component")).distinct())
