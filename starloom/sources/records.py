"""Transform records: JSON and JSON-lines scans, alias names, validation, ranking, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.geometry import finite, relative_error

FIELDS_2D = "matcher string, success boolean, scale double, rotation_deg double, R_yx array<array<double>>, t_um_yx array<double>, pixel_size_crop_um double, pixel_size_full_um double, A_px array<array<double>>, b_px array<double>, bbox_full_px_y0y1x0x1 array<int>, match_quality struct<success:boolean,frac_inliers:double,mean_error_um:double>, run_id string"
_ALIASED_3D = "best_scale double, best_R array<array<double>>, best_t array<double>, best_bbox array<int>, pixel_size_full_orig_um_zyx array<double>, voxel_size_full_um_zyx array<double>, pixel_size_crop_orig_um_zyx array<double>, pixel_size_patch_um_zyx array<double>, voxel_size_crop_um_zyx array<double>"
FIELDS_3D = "matcher string, success boolean, scale double, R_zyx array<array<double>>, t_um_zyx array<double>, pixel_size_crop_um_zyx array<double>, pixel_size_full_um_zyx array<double>, A_px array<array<double>>, b_px array<double>, bbox_full_px_z0z1y0y1x0x1 array<int>, match_quality struct<success:boolean,frac_inliers:double,mean_error_um:double>, run_id string, " + _ALIASED_3D

#: Canonical names and the names that older records use for them, in order of preference.
ALIASES_3D = {
    "scale": ("scale", "best_scale"),
    "R_zyx": ("R_zyx", "best_R"),
    "t_um_zyx": ("t_um_zyx", "best_t"),
    "bbox_full_px_z0z1y0y1x0x1": ("bbox_full_px_z0z1y0y1x0x1", "best_bbox"),
    "pixel_size_full_um_zyx": ("pixel_size_full_um_zyx", "pixel_size_full_orig_um_zyx", "voxel_size_full_um_zyx"),
    "pixel_size_crop_um_zyx": ("pixel_size_crop_um_zyx", "pixel_size_crop_orig_um_zyx", "pixel_size_patch_um_zyx", "voxel_size_crop_um_zyx"),
}


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files (one object) or JSON-lines files (one a line), with ``_source_path, _source_kind, _line, _text``.

    Lines are numbered from 1 within their file, blank ones counted and left out; a
    whole object is line 0. Files are read whole, as line numbers need all that
    stands before. Fields that the schema lacks stay in ``_text``.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_source_path"), F.col("value"))
    by_line = F.col("_source_path").endswith(".jsonl")
    whole = files.filter(~by_line).select("_source_path", F.lit("json").alias("_source_kind"), F.lit(0).alias("_line"), F.col("value").alias("_text"))
    lines = files.filter(by_line).select("_source_path", F.posexplode(F.split("value", "\r?\n")).alias("_at", "_text"))
    lines = lines.filter(F.trim("_text") != "").select("_source_path", F.lit("jsonl").alias("_source_kind"), (F.col("_at") + 1).alias("_line"), "_text")
    return parsed(whole.unionByName(lines), schema)


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Adds the record's fields; rows that are no JSON objects are left out, malformed ones raise."""
    value = F.from_json("_text", schema, {"mode": "FAILFAST"})
    return rows.filter(F.trim("_text").startswith("{")).withColumn("_r", value).select(*rows.columns, "_r.*")


def canonical_3d(rows: DataFrame) -> DataFrame:
    """Older names resolved; ``A_px`` and ``b_px`` derived where they are missing."""
    out = rows.withColumns({name: F.coalesce(*others) for name, others in ALIASES_3D.items()})
    out = out.drop(*[o for others in ALIASES_3D.values() for o in others[1:]])
    crop, full, r = F.col("pixel_size_crop_um_zyx"), F.col("pixel_size_full_um_zyx"), F.col("R_zyx")
    matrix = F.array(*[F.array(*[F.col("scale") * r[i][j] * crop[j] / full[i] for j in range(3)]) for i in range(3)])
    return out.withColumns({"A_px": F.coalesce("A_px", matrix), "b_px": F.coalesce("b_px", F.array(*[F.col("t_um_zyx")[i] / full[i] for i in range(3)]))})


def _vector(c: str, n: int) -> Column:
    return (F.size(c) == n) & F.forall(c, finite)


def _matrix(c: str, n: int) -> Column:
    return (F.size(c) == n) & F.forall(c, lambda row: (F.size(row) == n) & F.forall(row, finite))


def problems_2d() -> Column:
    """Everything that is wrong with a record, as an array of texts; empty for a valid one."""
    has_um = F.col("scale").isNotNull() & F.col("R_yx").isNotNull() & F.col("t_um_yx").isNotNull()
    has_px = F.col("A_px").isNotNull() & F.col("b_px").isNotNull()
    box = F.col("bbox_full_px_y0y1x0x1")
    checks = {
        "record is marked as failed": F.col("success") == F.lit(False),
        "no complete transform": ~(has_um | has_px),
        "scale is not positive": F.col("scale").isNotNull() & ~(finite("scale") & (F.col("scale") > 0)),
        "R_yx is not a finite 2x2 matrix": F.col("R_yx").isNotNull() & ~_matrix("R_yx", 2),
        "t_um_yx is not a finite pair": F.col("t_um_yx").isNotNull() & ~_vector("t_um_yx", 2),
        "A_px is not a finite 2x2 matrix": F.col("A_px").isNotNull() & ~_matrix("A_px", 2),
        "b_px is not a finite pair": F.col("b_px").isNotNull() & ~_vector("b_px", 2),
        "pixel_size_crop_um is not positive": F.col("pixel_size_crop_um").isNotNull() & ~(finite("pixel_size_crop_um") & (F.col("pixel_size_crop_um") > 0)),
        "pixel_size_full_um is not positive": F.col("pixel_size_full_um").isNotNull() & ~(finite("pixel_size_full_um") & (F.col("pixel_size_full_um") > 0)),
        "bounding box is not in order": box.isNotNull() & ~((F.size(box) == 4) & (F.get(box, F.lit(0)) <= F.get(box, F.lit(1))) & (F.get(box, F.lit(2)) <= F.get(box, F.lit(3)))),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in checks.items()]))


def problem_3d() -> Column:
    """The first thing that is wrong with a canonical record, or null."""
    checks = [(~(finite("scale") & (F.col("scale") > 0)), "scale"), (~_matrix("R_zyx", 3), "R_zyx"), *[(~_vector(c, 3), c) for c in ("t_um_zyx", "b_px")], (~_matrix("A_px", 3), "A_px")]
    checks += [(~(_vector(c, 3) & F.forall(c, lambda v: v > 0)), c) for c in ("pixel_size_crop_um_zyx", "pixel_size_full_um_zyx")]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(f"invalid {c}")) for bad, c in checks])


def validated(rows: DataFrame, problem: Column) -> DataFrame:
    """Strict mode: the rows, or an error that names the first line that is wrong."""
    text = F.concat_ws(" ", F.col("_source_path"), F.lit("line"), F.col("_line").cast("string"), F.lit(":"), problem)
    return rows.filter(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def penalty(sizes: Sequence[tuple[Column, Column]]) -> Column:
    """Sum of relative pixel size errors, plus 10 if one exceeds 2 %; unknown sizes count 0."""
    errors = [relative_error(have, want) for have, want in sizes]
    known = [F.coalesce(e, F.lit(0.0)) for e in errors]
    return sum(known, F.lit(0.0)) + F.when(F.greatest(*known, F.lit(0.0)) > 0.02, 10.0).otherwise(0.0)


def ranked(rows: DataFrame, sizes: Sequence[tuple[Column, Column]], missing_success: bool = True) -> DataFrame:
    """Successful records, best first: pixel penalty below 10, inliers, error, line. Adds ``penalty``."""
    q = F.col("match_quality")
    good = rows.filter(F.coalesce("success", F.lit(missing_success))).withColumn("penalty", penalty(sizes)).filter("penalty < 10")
    return good.orderBy("penalty", F.coalesce(-q["frac_inliers"], F.lit(1.0)), F.coalesce(q["mean_error_um"], F.lit(float("inf"))), "_line")


def write_json(rows: DataFrame, path: str, append: bool = True) -> None:
    """Append records as JSON lines in a folder."""
    rows.write.mode("append" if append else "errorifexists").json(path)
