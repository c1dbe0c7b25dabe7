"""Neighbour graphs, descriptors of points by their neighbours, and feature-space search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.geometry import tetrahedron, triangle_area2, triangle_descriptor
from starloom.operators.spatial import knn_join
from starloom.session import checkpointed


def neighbours(points: DataFrame, k: int, dims: Sequence[str] = ("y", "x"), by: Sequence[str] = ()) -> DataFrame:
    """``*by, i, j, dist, rank`` among the points themselves, none its own neighbour."""
    return knn_join(points.withColumnRenamed("pid", "i"), None, k, dims, by, skip_same_id=True)


def knn_edges(near: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Undirected edges ``i < j, dist`` of the k-nearest graph; coincident points have none."""
    return near.filter("dist >= 1e-6").select(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist").groupBy(*by, "i", "j").agg(F.min("dist").alias("dist"))


def adjacency(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, i, j, dist, rank``: all graph neighbours of each node, by distance."""
    both = edges.select(*by, "i", "j", "dist").unionByName(edges.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "i").orderBy("dist", "j")))


def _located(near: DataFrame, points: DataFrame, dims: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Neighbour rows with the coordinates of both ends: ``i{d}``, ``j{d}``."""
    one = points.select(*by, F.col("pid").alias("i"), *[F.col(d).alias(f"i{d}") for d in dims])
    two = points.select(*by, F.col("pid").alias("j"), *[F.col(d).alias(f"j{d}") for d in dims])
    return near.join(two.hint("merge"), [*by, "j"]).join(one.hint("merge"), [*by, "i"])  # points of any number are never broadcast


def triangle_features(near: DataFrame, points: DataFrame, n_triangles: int = 5, min_area2: float = 2e-6, by: Sequence[str] = ()) -> DataFrame:
    """``*by, i, f0, f1``: mean descriptor of the triangles of node, nearest neighbour and each of the next ones; 0 if none is valid."""
    rows = _located(near.filter(F.col("rank") <= n_triangles + 1), points, ("y", "x"), by)
    anchor = rows.filter("rank = 1").select(*by, "i", F.col("jy").alias("ay"), F.col("jx").alias("ax"))
    node, first, other = ((F.col(f"{p}y"), F.col(f"{p}x")) for p in ("i", "a", "j"))
    f0, f1 = triangle_descriptor(node, first, other)
    valid = triangle_area2(node, first, other) >= min_area2
    formed = rows.filter("rank > 1").join(anchor, [*by, "i"])
    means = formed.groupBy(*by, "i").agg(F.avg(F.when(valid, f0)).alias("f0"), F.avg(F.when(valid, f1)).alias("f1"))
    nodes = points.select(*by, F.col("pid").alias("i"))
    return nodes.join(means, [*by, "i"], "left").select(*by, "i", F.coalesce("f0", F.lit(0.0)).alias("f0"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def tetrahedron_features(near: DataFrame, points: DataFrame, n_tetra: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """``*by, i, f`` (seven numbers): mean descriptor of the first valid tetrahedra of a node and three neighbours, in order of neighbour ranks."""
    dims = ("z", "y", "x")
    rows = _located(near, points, dims, by)
    here = [F.col(f"i{d}") for d in dims]
    gathered = rows.groupBy(*by, "i", *[f"i{d}" for d in dims]).agg(F.array_sort(F.collect_list(F.struct("rank", *[f"j{d}" for d in dims]))).alias("ns"))  # k rows at most
    gathered = checkpointed(gathered)
    corner = lambda p: [F.col(f"{p}.j{d}") for d in dims]

    def first_valid(nodes: DataFrame, a: str, b: str) -> DataFrame:
        three = nodes
        for name, some in (("a", a), ("b", b), ("c", "filter(ns, n -> n.rank > b.rank)")):
            three = three.select("*", F.explode(F.expr(some)).alias(name))
        shape = tetrahedron([here, corner("a"), corner("b"), corner("c")])
        staged = three.withColumns({"_v": shape["volume"], "_e": shape["edges"]}).withColumn("_m", F.aggregate("_e", F.lit(0.0), lambda x, y: x + y) / 6)
        cube, low, high = F.greatest(F.col("_m") * F.col("_m") * F.col("_m"), F.lit(1e-12)), F.element_at("_e", 1), F.element_at("_e", 6)
        valid = staged.filter((low > 1e-8) & (high <= 50 * low) & (F.col("_v") / cube > 1e-4))
        parts = valid.select(
            *by, "i", F.row_number().over(Window.partitionBy(*by, "i").orderBy("a.rank", "b.rank", "c.rank")).alias("n"),
            (15 * F.col("_v") / cube).alias("d0"), *[(F.element_at("_e", e) / F.col("_m")).alias(f"d{e}") for e in range(1, 7)],
        )
        return parts.filter(F.col("n") <= n_tetra).groupBy(*by, "i").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"d{e}") for e in range(7)]).alias("f"))

    # the first in order are those with the two nearest; the few nodes with too few of them form all
    settled = checkpointed(first_valid(gathered, "slice(ns, 1, 1)", "slice(ns, 2, 1)").filter(F.col("n") == n_tetra))
    others = gathered.join(settled.select(*by, "i").hint("merge"), [*by, "i"], "left_anti")
    return settled.unionByName(first_valid(others, "ns", "filter(ns, n -> n.rank > a.rank)")).select(*by, "i", "f")


def graph_features(near: DataFrame, points: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """``*by, i, f`` (3k + 3 numbers): scaled distances, cosines and sines of the angles to the nearest edge, 0, local over global median, degree / k."""
    edges = knn_edges(near, by)
    middle = edges.groupBy(*by).agg(F.percentile("dist", 0.5).alias("mid")) if by else edges.agg(F.percentile("dist", 0.5).alias("mid"))
    rows = _located(adjacency(edges, by), points, ("y", "x"), by)
    angle = F.atan2(F.col("jy") - F.col("iy"), F.col("jx") - F.col("ix"))
    node = rows.groupBy(*by, "i").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "dist", angle.alias("a"))))).alias("ns"), F.percentile("dist", 0.5).alias("mine"), F.count(F.lit(1)).alias("degree")
    )
    node = node.join(F.broadcast(middle), list(by)) if by else node.crossJoin(F.broadcast(middle))  # one row a set
    padded = lambda part: F.slice(F.concat(part, F.array_repeat(F.lit(0.0), k)), 1, k)
    first = F.element_at("ns", 1)["a"]
    scaled = padded(F.transform("ns", lambda n: n["dist"] / F.greatest(F.col("mine"), F.lit(1e-12))))
    cosines = padded(F.transform("ns", lambda n: F.cos(n["a"] - first)))
    sines = padded(F.transform("ns", lambda n: F.sin(n["a"] - first)))
    tail = F.array(F.lit(0.0), F.col("mine") / (F.col("mid") + 1e-8), F.col("degree") / F.lit(float(k)))
    full = node.select(*by, "i", F.concat(scaled, cosines, sines, tail).alias("f"))
    alone = F.concat(F.array_repeat(F.lit(0.0), 3 * k), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    return points.select(*by, F.col("pid").alias("i")).join(full, [*by, "i"], "left").select(*by, "i", F.coalesce("f", alone).alias("f"))


def quad_features(near: DataFrame, points: DataFrame, by: Sequence[str] = (), k: int = 8, min_area2: float = 1e-6, n_quads: int = 14) -> DataFrame:
    """``*by, i, n1, n2, n3, f`` (ten numbers): of a centre and three of its neighbours by distance.

    The frame is scaled by the longest distance, turned so that the nearest neighbour lies on the
    positive x axis, and mirrored so that the second one's first component is not negative.
    """
    rows = _located(near.filter(F.col("rank") <= k), points, ("y", "x"), by)
    offset = F.struct("rank", "j", (F.col("jy") - F.col("iy")).alias("y"), (F.col("jx") - F.col("ix")).alias("x"), "dist")
    three = rows.groupBy(*by, "i").agg(F.array_sort(F.collect_list(offset)).alias("ns"))
    for name, after in (("a", None), ("b", "a"), ("c", "b")):
        three = three.select("*", F.explode(F.expr("ns" if after is None else f"filter(ns, n -> n.rank > {after}.rank)")).alias(name))
    three = three.withColumn("_l", F.greatest(F.col("c.dist"), F.lit(1e-12)))
    three = three.withColumns({f"_{p}{d}": F.col(f"{p}.{d}") / F.col("_l") for p in "abc" for d in "yx"})
    area2 = triangle_area2(*[[F.col(f"_{p}{d}") for d in "yx"] for p in "abc"])
    three = three.filter(area2 >= min_area2).withColumn("_t", F.atan2("_ay", "_ax"))
    cosine, sine = F.cos("_t"), F.sin("_t")
    three = three.withColumns({f"_{p}{d}r": v for p in "abc" for d, v in (("y", cosine * F.col(f"_{p}y") - sine * F.col(f"_{p}x")), ("x", sine * F.col(f"_{p}y") + cosine * F.col(f"_{p}x")))})
    three = three.withColumn("_s", F.when(F.col("_byr") < 0, -1.0).otherwise(1.0))
    flat = {p: [F.col(f"_{p}yr") * F.col("_s"), F.col(f"_{p}xr")] for p in "abc"}

    def between(p: str, q: str):
        a, b = flat[p], flat[q]
        norm = F.sqrt((a[0] * a[0] + a[1] * a[1]) * (b[0] * b[0] + b[1] * b[1]))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a[0] * b[0] + a[1] * b[1]) / F.greatest(norm, F.lit(1e-12)))))

    f = F.array(*[F.col(f"{p}.dist") / F.col("_l") for p in "abc"], *flat["a"], *flat["b"], between("a", "b"), between("b", "c"), between("c", "a"))
    chosen = three.select(*by, "i", F.col("a.j").alias("n1"), F.col("b.j").alias("n2"), F.col("c.j").alias("n3"), f.alias("f"))
    subset = F.row_number().over(Window.partitionBy(*by, "i").orderBy(F.pmod(F.col("n1") * 7919 + F.col("n2") * 6007 + F.col("n3") * 15487, F.lit(1000003)), "n1", "n2", "n3"))
    return chosen.withColumn("_r", subset).filter(F.col("_r") <= n_quads).drop("_r")


def feature_knn(queries: DataFrame, base: DataFrame, k: int, vector: str = "f", query_id: str = "i", base_id: str = "j", shard: int = 65_536, block: int = 4_096) -> DataFrame:
    """``i, j, dist, rank``: the k nearest vectors, by blocks of queries against shards of the base, merged exactly."""
    n_base, n_query = base.count(), queries.count()
    shards, blocks = max(1, -(-n_base // shard)), max(1, -(-n_query // block))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(part(base_id, shards).alias("s"), every(blocks).alias("b"), F.lit(False).alias("asks"), F.col(base_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    right = queries.select(every(shards).alias("s"), part(query_id, blocks).alias("b"), F.lit(True).alias("asks"), F.col(query_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids = table["id"].to_numpy()
        width = len(table["v"][0])
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        x, y = values[asks], values[~asks]
        out_i, out_j, out_d = [], [], []
        take = min(k, len(y))
        for at in range(0, len(x) if take else 0, 256):
            square = ((x[at : at + 256, None, :] - y[None, :, :]) ** 2).sum(2) if len(y) * width < 1 << 18 else _squares(x[at : at + 256], y)
            near = np.argpartition(square, take - 1, axis=1)[:, :take]
            limit = np.take_along_axis(square, near, 1).max(1)
            row, col = np.nonzero(square <= (limit * (1 + 1e-9) + 1e-9)[:, None])  # all ties
            exact = np.sqrt(((x[at + row] - y[col]) ** 2).sum(1))
            out_i.append(ids[asks][at + row])
            out_j.append(ids[~asks][col])
            out_d.append(exact)
        empty = np.zeros(0)
        return pa.table({"i": np.concatenate([*out_i, empty]).astype(np.int64), "j": np.concatenate([*out_j, empty]).astype(np.int64), "dist": np.concatenate([*out_d, empty])})

    pairs = left.unionByName(right).groupBy("s", "b").applyInArrow(run, "i long, j long, dist double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))).filter(F.col("rank") <= k)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)
