import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import analytics, raster, spatial, stats
from starloom.operators.components import connected_components


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 100, (120, 2)).round(3)
    points[:5] = points[5]  # coincident points
    df = spark.createDataFrame([(k, float(y), float(x)) for k, (y, x) in enumerate(points)], "pid long, y double, x double")
    return points, df.cache()


def distances(points):
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))


def test_radius_join_equals_brute_force(spark, cloud):
    points, df = cloud
    d = distances(points)
    want = {(i, j) for i in range(120) for j in range(120) if i != j and d[i, j] <= 9.5}
    for spread in (False, True):
        got = spatial.radius_join(df.withColumnRenamed("pid", "i"), df.withColumnRenamed("pid", "j"), 9.5, skip_same_id=True, spread_right=spread).collect()
        assert {(r.i, r.j) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("k", [1, 4, 200])
def test_knn_equals_brute_force(spark, cloud, k):
    points, df = cloud
    d = distances(points)
    got = spatial.knn_join(df.withColumnRenamed("pid", "i"), df.withColumnRenamed("pid", "j"), k, skip_same_id=True, radius=2.0).collect()
    for i in range(0, 120, 13):
        want = sorted((round(d[i, j], 9), j) for j in range(120) if j != i)[:k]
        assert sorted((round(r.dist, 9), r.j) for r in got if r.i == i) == want


def test_box_join_is_half_open(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.999, 5.0), (2, 10.0, 5.0)], "pid long, y double, x double")
    boxes = spark.createDataFrame([(7, 0, 10, 0, 10), (8, 10, 20, 5, 6)], "box_id long, y0 long, y1 long, x0 long, x1 long")
    got = {(r.box_id, r.pid) for r in spatial.box_join(points, boxes, 4.0).collect()}
    assert got == {(7, 0), (7, 1), (8, 2)}


def test_sanitising(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.01, 0.0, 0.0), (2, nan, 1.0, 1.0), (3, 1.0, inf, 1.0), (4, 5.0, 5.0, 5.0)], "pid long, z double, y double, x double")
    finite = spatial.finite_points(rows, ["z", "y", "x"])
    assert finite.count() == 3
    assert spatial.merge_duplicates(finite, 0.1).count() == 2


def test_z_scores_and_empty_reference(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double")
    got = [r.v for r in stats.zscore(stats.impute_median(df, df, ["v"]), df, ["v"]).collect()]
    assert got == pytest.approx([-1, 1, 0])
    assert stats.impute_median(df, df.limit(0), ["v"]).filter("isnan(v)").count() == 0


def test_bins_are_right_closed(spark):
    got = spark.createDataFrame([(3,), (10,), (11,), (30,), (31,)], "n int").select(stats.right_closed_bin(F.col("n"), [3, 10, 30]).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 1, 1, None]


def test_wilson_without_trials_is_unknown(spark):
    low, high = stats.wilson_interval(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low.alias("a"), high.alias("b")).first()) == (None, None)


def test_unknown_measures_do_not_pass(spark):
    rows = spark.createDataFrame([(True, 0.9, 1.0, float("nan")), (True, 0.9, 1.0, 0.95), (None, 0.9, 1.0, 0.95)], "success boolean, frac_inliers double, trans_error_px double, ssim double")
    assert [r.passed for r in analytics.scored(rows).collect()] == [False, True, False]


def test_components(spark):
    edges = [(k, k + 1) for k in range(20, 40)] + [(3, 9), (9, 5), (1, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 20 for k in range(20, 41)}, 3: 3, 9: 3, 5: 3, 1: 1}


def test_cube_measures(spark):
    cube = spark.createDataFrame([(z, y, x, 1) for z in (0, 1) for y in (0, 1) for x in (0, 1)], "z int, y int, x int, label int")
    row = raster.voxel_measures(cube, (2.0, 0.5, 0.5)).first()
    assert (row["voxels"], row["volume_um3"], row["surface_um2"]) == (8, 4.0, 2 * (1 * 1 + 4 * 1 + 4 * 1))


def test_stitching_inherits_and_renews(spark):
    rows = [(0, 0, x, 1) for x in range(10)] + [(1, 0, x, 7) for x in range(1, 11)] + [(2, 0, x, 2) for x in range(30, 40)]
    got = raster.stitch_slices(spark.createDataFrame(rows, "z int, y int, x int, label int"), 0.5).groupBy("z").agg(F.max("label").alias("l")).collect()
    assert {r.z: r.l for r in got} == {0: 1, 1: 1, 2: 2}
