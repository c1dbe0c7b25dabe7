import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import geometry as geo
from starloom.functions import text as tx
from starloom.operators import registration as reg
from starloom.operators import stats
from starloom.plans.config import DEFAULTS_2D, DEFAULTS_3D, merged, settings


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_clamp_keeps_a_least_size(spark):
    ranges = [((-5, -2), 2), ((15, 16), 2), ((2, 2), 2)]
    got = [tuple(one(spark, *geo.clamp_range(F.lit(a), F.lit(b), 10, n))) for (a, b), n in ranges]
    assert got == [(0, 2), (8, 10), (2, 4)]


def test_footprint_outside_is_one_pixel(spark):
    corners = [[F.lit(float(a - 10)), F.lit(float(b - 10)), F.lit(float(c - 10))] for a in (0, 5) for b in (0, 6) for c in (0, 7)]
    box = geo.footprint_box(corners, (0, 0, 0), (1, 1, 1), (4, 4, 4))
    assert tuple(one(spark, *box)) == (0, 1, 0, 1, 0, 1)


def test_closed_form_fit_matches_svd(spark):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.normal(size=4))) for k in range(7) for _ in range(6)]
    df = spark.createDataFrame(rows, "g int, py double, px double, qy double, qx double")
    pid = df.withColumn("pid", F.monotonically_increasing_id())
    for g in range(7):
        part = pid.filter(F.col("g") == g)
        fit = reg.fit_pairs_2d(part.select(F.col("pid").alias("i"), F.col("pid").alias("j")), part.select("pid", F.col("py").alias("y"), F.col("px").alias("x")), part.select("pid", F.col("qy").alias("y"), F.col("qx").alias("x"))).first()
        v = np.array([r[1:] for r in rows if r[0] == g])
        a, b = v[:, :2] - v[:, :2].mean(0), v[:, 2:] - v[:, 2:].mean(0)
        u, s, vt = np.linalg.svd(a.T @ b)
        d = np.diag([1, np.sign(np.linalg.det(u @ vt))])
        r = (u @ d @ vt).T
        assert fit["scale"] == pytest.approx(s.sum() / (a**2).sum())
        assert (fit["r00"], fit["r10"]) == pytest.approx((r[0, 0], r[1, 0]))


def test_fit_3d_counts_a_reflection_negative():
    rng = np.random.default_rng(4)
    p = rng.normal(size=(5, 8, 3))
    q = p * np.array([1, 1, -1])
    scale, rotation, _, ok = reg.fit_3d(p, q)
    assert ok.all() and np.allclose(np.linalg.det(rotation), 1) and (scale < 1).all()
    scale, rotation, shift, ok = reg.fit_3d(p, 1.5 * p + 2)
    assert np.allclose(scale, 1.5) and np.allclose(rotation, np.eye(3)) and np.allclose(shift, 2)


def test_degenerate_sets_have_no_map(spark):
    same = spark.createDataFrame([(0, *[1.0] * 12)], "hid long, " + ", ".join(f"{s}{d}{k} double" for k in range(3) for s in "pq" for d in "yx"))
    assert reg.fit_sets_2d(same, 3).count() == 0


def test_min_inliers(spark):
    rows = [one(spark, stats.min_inliers_3d(F.lit(n), a, f, 3, c).alias("v"))["v"] for n, a, f, c in ((30, 40, 0.95, 0.8), (10, 1, 0.5, 0.8), (10, 20, 0.5, 0.8))]
    assert rows == [24, 5, 8]


def test_text_functions(spark):
    got = one(spark, tx.ratio(F.lit("300/1")).alias("a"), tx.ratio(F.lit("1/0")).alias("b"), tx.scalar_text(F.lit("100_000")).alias("c"), tx.scalar_text(F.lit("None")).alias("d"), tx.unit_name(F.lit("µm")).alias("e"), tx.key_values(F.lit("unit=um\nspacing=2.5")).alias("f"), tx.adler32(F.lit("AFRICA")).alias("g"))
    assert tuple(got) == (300.0, None, "100000", "null", "um", {"unit": "um", "spacing": "2.5"}, 97780135)


def test_settings_merge_and_reject():
    assert settings("hashing", DEFAULTS_2D, {"n_iters": 7})["n_iters"] == 7
    assert settings("graph", DEFAULTS_2D, {"_common": {"scale_min": 0.9}})["scale_min"] == 0.9
    assert settings("pyramid", DEFAULTS_3D)["inlier_radius_um"] == 3.0
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(KeyError):
        settings("quad", DEFAULTS_2D, {"no_such_key": 1})
    with pytest.raises(KeyError):
        settings("nothing", DEFAULTS_2D)


def test_angles(spark):
    got = one(spark, geo.wrap_half_turn(F.lit(3.5)).alias("a"), geo.circular_difference(F.lit(0.1), F.lit(6.2)).alias("b"), geo.rotation_deg_3d(F.lit(3.0)).alias("c"))
    assert tuple(got) == pytest.approx((3.5 - 2 * math.pi, 0.1 - 6.2 + 2 * math.pi, 0.0))
