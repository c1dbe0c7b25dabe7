"""Benchmark analytics over job tables: scoring, curves, thresholds, coverage, resuming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.geometry import nan_to_null
from starloom.operators.stats import right_closed_bin, wilson_interval


def scored(rows: DataFrame, min_frac: float = 0.8, max_error_px: float = 20.0, min_ssim: float | None = 0.8) -> DataFrame:
    """Adds ``passed``: reported success, enough inliers, a small error and a similar image; unknown values fail."""
    frac, error = nan_to_null("frac_inliers"), nan_to_null("trans_error_px")
    good = F.coalesce(F.col("success"), F.lit(False)) & (frac >= min_frac) & (error < max_error_px)
    if min_ssim is not None:
        good = good & (nan_to_null("ssim") >= min_ssim)
    return rows.withColumn("passed", F.coalesce(good, F.lit(False)))


def success_by_bin(rows: DataFrame, edges: Sequence[float], count_col: str = "n_nuclei", by: Sequence[str] = ("matcher",)) -> DataFrame:
    """``*by, bin, n, n_passed, p, p_low, p_high, mean_n``: share of passed jobs for each bin of point counts, with 95 % intervals."""
    binned = rows.withColumn("bin", right_closed_bin(F.col(count_col), edges)).filter("bin is not null")
    counted = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed"), F.avg(count_col).alias("mean_n"))
    low, high = wilson_interval(F.col("n_passed"), F.col("n"))
    return counted.select(*by, "bin", "n", "n_passed", (F.col("n_passed") / F.col("n")).alias("p"), low.alias("p_low"), high.alias("p_high"), "mean_n")


def sustained_threshold(curve: DataFrame, target: float, by: Sequence[str] = ("matcher",), x: str = "mean_n", p: str = "p") -> DataFrame:
    """``*by, threshold``: the smallest x from which on p stays at the target (null if it never does)."""
    later = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = curve.withColumn("_least", F.min(p).over(later))
    return held.groupBy(*by).agg(F.min(F.when(F.col("_least") >= target, F.col(x))).alias("threshold"))


def error_tolerance(curve: DataFrame, target: float, by: Sequence[str], error: str = "error_pct", p: str = "p") -> DataFrame:
    """``*by, tolerance``: the largest tested error at which p reaches the target, whatever lies below."""
    return curve.groupBy(*by).agg(F.max(F.when(F.col(p) >= target, F.col(error))).alias("tolerance"))


def best_by_group(rows: DataFrame, value: str, name: str, by: Sequence[str]) -> DataFrame:
    """``*by, name, value``: the name with the largest value (of equal ones the first by name)."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), F.col(name))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*by, name, value)


def group_summary(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``*by, n_rows, n_values, mean, median, q25, q75, lowest, highest``; NaN counts as missing."""
    v = nan_to_null(value)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_values"), F.avg(v).alias("mean"), *[F.percentile(v, q).alias(n) for q, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))],
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
    )


def failure_histogram(rows: DataFrame, by: Sequence[str], reason: str = "failure_reason") -> DataFrame:
    """Failed rows by reason; rows without one count as ``unknown``."""
    return rows.filter("not passed").groupBy(*by, F.coalesce(reason, F.lit("unknown")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows of each ``row`` value in one column for each of the given values of ``column``."""
    return rows.groupBy(row).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values])


def repeated_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(many, list(keys), "left_semi")


def unfinished(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs whose key has no finished row yet."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def most_populated(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value (of equal ones the smallest) and its count."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(1)


def attempt_score(had_transform: Column, frac: Column, error: Column, seconds: Column) -> Column:
    """Ranks attempts: inliers first, then error and time; no transform is far below all."""
    bad = F.lit(-1e12) + 100 * F.coalesce(frac, F.lit(0.0))
    good = 1000 * F.coalesce(frac, F.lit(0.0)) - error - 0.05 * F.coalesce(seconds, F.lit(0.0))
    return F.when(~had_transform, bad).otherwise(F.coalesce(good, F.lit(float("-inf"))))


def patch_grid(height: int, width: int, size: int, stride: int, spark) -> DataFrame:
    """``box_id, y0, y1, x0, x1`` of all square patches of a stride that lie inside."""
    ys, xs = (max((n - size) // stride + 1, 0) for n in (height, width))
    grid = spark.range(ys * xs)
    y0, x0 = F.floor(F.col("id") / xs) * stride, F.col("id") % xs * stride
    return grid.select(F.col("id").alias("box_id"), y0.cast("long").alias("y0"), (y0 + size).cast("long").alias("y1"), x0.cast("long").alias("x0"), (x0 + size).cast("long").alias("x1"))


def job_grid(patches: DataFrame, settings: Mapping[str, Sequence]) -> DataFrame:
    """Every patch with every combination of settings, which are few and given: one row a job."""
    out = patches
    for name, values in settings.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def unit_interval(key: Column | str, seed: int) -> Column:
    """A portable pseudo-random number in [0, 1) for an integer key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(k * k * 7919 + k * 104729 + seed * 15487, F.lit(1000003)) / 1000003.0


def perturbed(points: DataFrame, missed: float, extra: float, box: tuple[float, float, float, float], seed: int = 0) -> DataFrame:
    """``pid, y, x, fake``: points that stay, and round(extra * n) uniform fakes with negative ids."""
    stay = points.filter(unit_interval("pid", seed) >= missed).select("pid", "y", "x", F.lit(False).alias("fake"))
    n = points.count()
    y0, y1, x0, x1 = box
    ids = points.sparkSession.range(round(extra * n)).select((-F.col("id") - 1).alias("pid"))
    u = lambda s: unit_interval(-F.col("pid"), seed + s)
    return stay.unionByName(ids.select("pid", (y0 + (y1 - y0) * u(1)).alias("y"), (x0 + (x1 - x0) * u(2)).alias("x"), F.lit(True).alias("fake")))
