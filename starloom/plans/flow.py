"""A whole run: adaptive registration, its records on disk, and results that a run goes on from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import boxes
from starloom.functions.geometry import affine_px_2d
from starloom.plans.matching import adaptive
from starloom.sources.records import write_json

_MAP = "matcher string, success boolean, scale double, r00 double, r10 double, t0 double, t1 double, n_inliers long, frac_inliers double, mean_error_um double"


def transform_record(spark: SparkSession, row: Mapping, um_crop: float, um_full: float, shape_crop: Sequence[int], shape_full: Sequence[int], require_success: bool = True) -> DataFrame:
    """The record of a 2-D map in micrometres and pixels, with its box in the full image: one row.

    A result that failed is an error, unless ``require_success`` is off; without a map it always is.
    """
    if row["scale"] is None or (require_success and not row["success"]):
        raise ValueError("no successful map to record")
    one = spark.createDataFrame([tuple(row[f.split()[0]] for f in _MAP.split(", "))], _MAP)
    s, c, n = F.col("scale"), F.col("r00"), F.col("r10")
    px = affine_px_2d(s, c, n, F.col("t0"), F.col("t1"), F.lit(float(um_crop)), F.lit(float(um_full)))
    box = boxes.mapped(px, shape_crop, shape_full)
    return one.select(
        "matcher", "success", "scale", F.array(F.array(c, -n), F.array(n, c)).alias("R_yx"), F.array("t0", "t1").alias("t_um_yx"),
        F.array(F.array(px["a00"], px["a01"]), F.array(px["a10"], px["a11"])).alias("A_px"), F.array(px["b0"], px["b1"]).alias("b_px"),
        F.lit(float(um_crop)).alias("pixel_size_crop_um"), F.lit(float(um_full)).alias("pixel_size_full_um"), F.array(*box).alias("bbox_full_px_y0y1x0x1"),
        F.struct("frac_inliers", "mean_error_um", "n_inliers").alias("match_quality"),
    )


def summary(record: DataFrame) -> DataFrame:
    """What is worth a glance of a record."""
    quality = F.struct("match_quality.frac_inliers", "match_quality.mean_error_um").alias("match_quality")
    return record.select("success", "matcher", F.col("scale").alias("best_scale"), F.col("t_um_yx").alias("best_t_um"), F.col("R_yx").alias("best_R"), quality)


def attempt_line(history: DataFrame) -> DataFrame:
    """``attempt, line``: each attempt in words."""
    share, error = F.format_number("frac_inliers", 3), F.coalesce(F.format_number("mean_error_um", 3), F.lit("-"))
    parts = [F.concat(F.lit("["), F.col("attempt") + 1, F.lit("] "), F.col("matcher")), F.when(F.col("success"), "found").otherwise("not found"), F.concat(share, F.lit(" inliers")), F.concat(error, F.lit(" um"))]
    return history.select("attempt", F.concat_ws(", ", *parts).alias("line"))


def adaptive_export(query: DataFrame, reference: DataFrame, path: str, um_crop: float, um_full: float, shape_crop: Sequence[int], shape_full: Sequence[int], **options) -> DataFrame:
    """Register adaptively and append what came of it to JSON lines under ``path``: ``history``, and
    where a map succeeded ``transforms`` and ``summary``. Returns the history."""
    spark = query.sparkSession
    best, history = adaptive(query, reference, **options)
    write_json(history, f"{path}/history")
    if best is not None and best["success"]:
        record = transform_record(spark, best, um_crop, um_full, shape_crop, shape_full)
        write_json(record, f"{path}/transforms")
        write_json(summary(record), f"{path}/summary")
    return history


def stored_results(spark: SparkSession, path: str, numbers: Sequence[str] = ()) -> DataFrame:
    """Results of earlier runs from CSV files with a header; what is no number in a column of numbers is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numbers if c in rows.columns})
