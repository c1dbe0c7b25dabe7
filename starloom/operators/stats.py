"""Reference statistics of features and robust summaries, by group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.geometry import clip, finite
from starloom.operators.spatial import knn_join


def _or_null(c: str) -> Column:
    return F.when(finite(c), F.col(c))


def impute_median(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that aren't finite become the reference's median of finite values, or 0."""
    medians = reference.agg(*[F.percentile(_or_null(c), 0.5).alias(f"_m_{c}") for c in columns])  # one row
    filled = {c: F.coalesce(_or_null(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(medians)).withColumns(filled).drop(*[f"_m_{c}" for c in columns])


def zscore(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the reference's finite values; a deviation below 1e-12 counts as 1."""
    stats = reference.agg(*[f(_or_null(c)).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def median_and_mad(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``*by, median, mad`` of the finite values."""
    rows = df.select(*by, _or_null(column).alias("_v")).filter("_v is not null")
    middle = rows.groupBy(*by).agg(F.percentile("_v", 0.5).alias("median"))
    joined = rows.join(middle, list(by)) if by else rows.crossJoin(F.broadcast(middle))
    return joined.groupBy(*by, "median").agg(F.percentile(F.abs(F.col("_v") - F.col("median")), 0.5).alias("mad"))


def cap_by_mad(pairs: DataFrame, factor: float = 6.0, column: str = "dist") -> DataFrame:
    """Rows up to median + factor * MAD."""
    limit = median_and_mad(pairs, column).select((F.col("median") + factor * F.col("mad")).alias("_limit"))
    return pairs.crossJoin(F.broadcast(limit)).filter(F.col(column) <= F.col("_limit")).drop("_limit")


def first_ranked(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first rows by an order, as a sort with a limit (no window over one partition)."""
    return df.orderBy(*order).limit(n)


def nearest_spacing(points: DataFrame, dims: Sequence[str] = ("y", "x")) -> DataFrame:
    """One row ``spacing``: median distance to the nearest other point."""
    near = knn_join(points.withColumnRenamed("pid", "i"), None, 1, dims, skip_same_id=True)
    return near.filter("dist > 0").agg(F.percentile("dist", 0.5).alias("spacing"))


def scale_prior(query: DataFrame, reference: DataFrame, dims: Sequence[str] = ("y", "x"), tolerance: float = 0.2, coarse: tuple[float, float] = (0.5, 2.0), density_gate: float = 0.0) -> DataFrame:
    """One row ``prior, scale_min, scale_max`` from spacing and density cues.

    Cues outside (0.1, 10) are dropped, as is a density cue whose logarithm is below
    ``density_gate``; the prior is the median of the rest. The bounds are
    prior * (1 -+ tolerance) within the coarse ones, or those if nothing is left.
    """

    def cues(points: DataFrame, tag: str) -> DataFrame:
        box = points.agg(F.count(F.lit(1)).alias("n"), *[(F.max(d) - F.min(d)).alias(f"w{d}") for d in dims])
        volume = F.lit(1.0)
        for d in dims:
            volume = volume * F.greatest(F.col(f"w{d}"), F.lit(1e-9))
        return box.select((F.col("n") / volume).alias(f"density_{tag}")).crossJoin(nearest_spacing(points, dims).withColumnRenamed("spacing", f"spacing_{tag}"))

    both = cues(query, "q").crossJoin(cues(reference, "r"))  # one row each
    spacing = F.col("spacing_r") / F.col("spacing_q")
    density = F.pow(F.col("density_q") / F.col("density_r"), 1.0 / len(dims))
    gated = F.when(F.abs(F.log(density)) >= density_gate, density)
    usable = F.filter(F.array_sort(F.array(spacing, gated)), lambda c: c.isNotNull() & (c > 0.1) & (c < 10))
    n = F.size(usable)
    prior = F.when(n > 0, (F.get(usable, F.floor((n - 1) / 2).cast("int")) + F.get(usable, F.floor(n / 2).cast("int"))) / 2)
    low, high = (F.when(prior.isNotNull(), clip(prior * (1 + s * tolerance), *coarse)).otherwise(F.lit(c)) for s, c in ((-1, coarse[0]), (1, coarse[1])))
    return both.select(prior.alias("prior"), F.when(low < high, low).otherwise(coarse[0]).alias("scale_min"), F.when(low < high, high).otherwise(coarse[1]).alias("scale_max"))


def min_inliers_2d(n: Column, absolute: int, fraction: float, floor: int = 3, cap: float = 0.8) -> Column:
    """clip(max(abs, ceil(fraction n)), floor, max(floor, floor(cap n)))."""
    want = F.greatest(F.lit(absolute), F.ceil(n * F.lit(fraction)).cast("int"))
    return F.greatest(F.lit(floor), F.least(want, F.greatest(F.lit(floor), F.floor(n * F.lit(cap)).cast("int"))))


def min_inliers_3d(n: Column, absolute: int, fraction: float, floor: int = 3, cap: float = 0.8) -> Column:
    """min(max(floor, abs, floor(fraction n + 1/2)), max(floor, floor(cap n))); the first alone for n <= 0."""
    want = F.greatest(F.lit(floor), F.lit(absolute), F.floor(n * F.lit(fraction) + 0.5).cast("int"))
    return F.when(n <= 0, want).otherwise(F.least(want, F.greatest(F.lit(floor), F.floor(n * F.lit(cap)).cast("int"))))


def wilson_interval(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the share of successes; null without trials."""
    p = successes / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    down = 1 + z * z / n
    return tuple(F.when(n > 0, clip(bound / down, 0, 1)) for bound in (middle - width, middle + width))


def logistic_success(n: Column, slope: float, middle: float) -> Column:
    """Modelled chance of success for n points: logistic in log10 n."""
    return 1 / (1 + F.exp(-slope * (F.log10(n) - middle)))


def points_for_success(target: float, slope: float, middle: float) -> float:
    """The n at which the model reaches the target."""
    return 10 ** (middle + math.log(target / (1 - target)) / slope)


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin (a, b] that holds x; the first bin includes its left edge; null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), 0)
    for k in range(1, len(edges) - 1):
        out = out.when((x > edges[k]) & (x <= edges[k + 1]), k)
    return out


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
