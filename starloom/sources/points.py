"""Point sets from tables of any kind: named views with ids and coordinates.

The driver's tables hold no microscopy, so keys are scattered by quadratic integer
formulas. They are the same in any SQL engine and leave no lattice behind that a
wrong shift could match.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import read_table

#: Per axis: factor of k^2, factor of k, shift, modulus.
AXES = {"z": (22307, 31337, 99, 50021), "y": (7919, 104729, 12345, 100003), "x": (6007, 15487, 777, 100019)}
#: The map that sends query points to the reference, and the box they are cut from.
TRUTH_2D = {"scale": 1.25, "angle_deg": 31.0, "t0": 18.0, "t1": -12.0}
QUERY_BOX = (300.0, 380.0)


def coordinate(axis: str, key: str) -> str:
    a, b, c, m = AXES[axis]
    return f"cast(({key} * {key} * {a} + {key} * {b} + {c}) % {m} as double) / cast(100 as double)"


def reference_points(spark: SparkSession, sf_dir: str, dims: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """``pid`` and coordinates of every order."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("pid"), *[F.expr(coordinate(d, "o_orderkey")).alias(d) for d in dims])


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points of a box, mapped back by the inverse of ``TRUTH_2D``."""
    low, high = QUERY_BOX
    s, angle = TRUTH_2D["scale"], math.radians(TRUTH_2D["angle_deg"])
    c, sn = math.cos(angle), math.sin(angle)
    dy, dx = F.col("y") - TRUTH_2D["t0"], F.col("x") - TRUTH_2D["t1"]
    inside = (F.col("y") >= low) & (F.col("y") < high) & (F.col("x") >= low) & (F.col("x") < high)
    return reference_points(spark, sf_dir).filter(inside).select("pid", ((c * dy + sn * dx) / s).alias("y"), ((-sn * dy + c * dx) / s).alias("x"))


#: The same in three dimensions: a turn about the z axis.
TRUTH_3D = {"scale": 1.1, "angle_deg": 20.0, "t0": 7.0, "t1": -6.0, "t2": 9.0}
QUERY_BOX_3D = ((150.0, 350.0), (300.0, 500.0), (300.0, 500.0))


def query_points_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points of a 3-D box, mapped back by the inverse of ``TRUTH_3D``."""
    t, angle = TRUTH_3D, math.radians(TRUTH_3D["angle_deg"])
    c, sn = math.cos(angle), math.sin(angle)
    inside = F.lit(True)
    for d, (low, high) in zip("zyx", QUERY_BOX_3D, strict=True):
        inside = inside & (F.col(d) >= low) & (F.col(d) < high)
    dz, dy, dx = (F.col(d) - t[f"t{k}"] for k, d in enumerate("zyx"))
    held = reference_points(spark, sf_dir, ("z", "y", "x")).filter(inside)
    return held.select("pid", (dz / t["scale"]).alias("z"), ((c * dy + sn * dx) / t["scale"]).alias("y"), ((-sn * dy + c * dx) / t["scale"]).alias("x"))


def centroids(features: DataFrame, pixel: dict[str, float] | None = None) -> DataFrame:
    """Coordinates in micrometres from a feature table: ``centroid_*_um``, else ``centroid_*_px`` times the pixel size."""
    dims = [d for d in ("z", "y", "x") if f"centroid_{d}_um" in features.columns or f"centroid_{d}_px" in features.columns]
    if not {"y", "x"} <= set(dims):
        raise ValueError("the feature table has no centroid columns")
    columns = []
    for d in dims:
        if f"centroid_{d}_um" in features.columns:
            columns.append(F.col(f"centroid_{d}_um").cast("double").alias(d))
        elif pixel is None:
            raise ValueError("pixel centroids need a pixel size")
        else:
            columns.append((F.col(f"centroid_{d}_px") * float(pixel[d])).alias(d))
    return features.select(*[c for c in ("set_id", "pid", "label") if c in features.columns], *columns)
