"""Queries on boxes, pixel sizes, angles, maps and job grids, and of whole runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import boxes
from starloom.functions import geometry as geo
from starloom.operators import analytics, raster
from starloom.operators import spatial as sp
from starloom.operators.neighbours import neighbours
from starloom.plans import flow
from starloom.plans.catalog import query
from starloom.plans.spatial_queries import _REF, _knn
from starloom.session import read_table, scratch_path
from starloom.sources import records
from starloom.sources.points import QUERY_BOX, TRUTH_2D, query_points, reference_points

_PI = repr(math.pi)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part")


_BOX = "p_partkey % 50 as y0, p_partkey % 50 + p_size as y1, p_size as x0, p_size + p_partkey % 31 as x1"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).selectExpr("p_partkey", *_BOX.split(", "))


def _box() -> list:
    return boxes.checked(["y0", "y1", "x0", "x1"])


@query(f"with b as (select p_partkey, {_BOX} from part) select p_partkey, y1 - y0 as height, x1 - x0 as width, x1 - x0 <= 0 or y1 - y0 <= 0 as empty, list_value(y0, x0, y1 - y0, x1 - x0)::varchar as yxhw, y0 - 3 as low, y1 + 3 as high from b")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _box()
    height, width = boxes.sides(box)
    forms = boxes.shape_names(dict(zip(("y0", "y1", "x0", "x1"), box, strict=True)))
    wide = boxes.grown(box, 2.4)
    listed = F.concat(F.lit("["), F.array_join(forms["yxhw"].cast("array<string>"), ", "), F.lit("]"))
    return _boxes(spark, sf_dir).select("p_partkey", height.alias("height"), width.alias("width"), boxes.is_empty(box).alias("empty"), listed.alias("yxhw"), wide[0].alias("low"), wide[1].alias("high"))


@query(f"with b as (select p_partkey, {_BOX} from part) select p_partkey, greatest(0, y0 - 4) as y0, least(60, y1 + 4) as y1, greatest(0, x0 - 2) as x0, least(55, x1 + 2) as x1 from b")
def box_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = boxes.grown(_box(), (3.2, 2), (60, 55))
    return _boxes(spark, sf_dir).select("p_partkey", *[c.alias(n) for c, n in zip(wide, ("y0", "y1", "x0", "x1"), strict=True)])


@query(f"with b as (select p_partkey, {_BOX} from part) select p_partkey, y0, y1, x0, x1 from b")
def box_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that are written as arrays in odd rows and as structs in others."""
    b = _boxes(spark, sf_dir)
    listed = F.when(F.col("p_partkey") % 2 == 1, F.array("y0", "y1", "x0", "x1"))
    named = F.when(F.col("p_partkey") % 2 == 0, F.struct("y0", "y1", "x0", "x1"))
    rows = b.select("p_partkey", listed.alias("listed"), named.alias("named"))
    return rows.select("p_partkey", *[c.alias(n) for c, n in zip(boxes.normalised(F.col("listed"), F.col("named")), ("y0", "y1", "x0", "x1"), strict=True)])


_MOVED_BOX = "p_partkey % 50 + p_size % 9 as v0, p_partkey % 50 + p_size + p_size % 13 as v1, p_size + p_size % 7 as u0, p_size + p_partkey % 31 + p_size % 11 as u1"


@query(f"""with b as (select p_partkey, {_BOX}, {_MOVED_BOX} from part),
s as (select *, greatest(1, y1 - y0) as ha, greatest(1, x1 - x0) as wa, greatest(1, v1 - v0) as hb, greatest(1, u1 - u0) as wb from b)
select p_partkey, abs(ha - hb) / hb > 0.25 or abs(wa - wb) / wb > 0.25 or abs((y0 + y1) / 2 - (v0 + v1) / 2) / hb > 0.25 or abs((x0 + x1) / 2 - (u0 + u1) / 2) / wb > 0.25 as mismatch from s""")
def box_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).selectExpr("p_partkey", *_BOX.split(", "), *_MOVED_BOX.split(", "))
    return rows.select("p_partkey", boxes.differs(_box(), [F.col(c) for c in ("v0", "v1", "u0", "u1")]).alias("mismatch"))


_CORNERS = "(select p_partkey, p_size / 50.0 as a, p_size / 80.0 as b, p_retailprice / 100 + 0.00137 as t0, p_retailprice / 150 - 3.00139 as t1 from part)"


@query(f"""with m as {_CORNERS},
c as (select p_partkey, least(0, 40 * a, -30 * b, 40 * a - 30 * b) + t0 as y0, greatest(0, 40 * a, -30 * b, 40 * a - 30 * b) + t0 as y1, least(0, 40 * b, 30 * a, 40 * b + 30 * a) + t1 as x0, greatest(0, 40 * b, 30 * a, 40 * b + 30 * a) + t1 as x1 from m)
select p_partkey, floor(y0)::int - 2 as y0, ceil(y1)::int + 2 as y1, floor(x0)::int - 2 as x0, ceil(x1)::int + 2 as x1 from c""")
def box_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size") / 50.0, F.col("p_size") / 80.0
    affine = {"a00": a, "a01": -b, "a10": b, "a11": a, "b0": F.col("p_retailprice") / 100 + 0.00137, "b1": F.col("p_retailprice") / 150 - 3.00139}
    box = boxes.mapped(affine, (40, 30), margin=2)
    return _part(spark, sf_dir).select("p_partkey", *[c.alias(n) for c, n in zip(box, ("y0", "y1", "x0", "x1"), strict=True)])


@query("""with s as (select p_partkey, p_size / 10.0 as f, (p_partkey % 17 + 1) / 8.0 as c from part)
select p_partkey, greatest(f, c) as coarsest, least(f, c) as finest, (f + c) / 2 as mean, f as match_full, 0.7::double as given from s""")
def common_pixel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, crop = F.col("p_size") / 10.0, (F.col("p_partkey") % 17 + 1) / 8.0
    names = {"coarsest": "MAX", "finest": "finest", "mean": "avg", "match_full": " match_crop_to_full", "given": "manual"}
    return _part(spark, sf_dir).select("p_partkey", *[boxes.common_pixel_size(full, crop, s, 0.7).alias(n) for n, s in names.items()])


@query("""with s as (select p_partkey, case when p_size > 40 then p_size / 100 end as m, case when p_size % 3 = 0 then 0.0 when p_size % 3 = 1 then p_size / 50 end as t from part)
select p_partkey, coalesce(m, case when t > 0 then t end, 0.5) as um_per_px, case when m is not null then 'manual' when t > 0 then 'metadata' else 'fallback' end as source, coalesce(case when t > 0 then t end, 0.25) as voxel from s""")
def resolved_pixel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    manual, meta = F.when(size > 40, size / 100), F.when(size % 3 == 0, 0.0).when(size % 3 == 1, size / 50)
    found = boxes.resolved_pixel_size(manual, meta, 0.5)
    return _part(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in found.items()], boxes.required_voxel_size(meta, F.lit(0.25)).alias("voxel"))


@query(f"""with m as (select p_partkey, p_size / 10.0 as x, p_size * 3.7 as o from part)
select p_partkey, round(x - 2 * {_PI} * floor(x / (2 * {_PI})), 6) as turn, round(x + {_PI} - 2 * {_PI} * floor((x + {_PI}) / (2 * {_PI})) - {_PI}, 6) as half, round(case when p_partkey % 5 = 0 then o else o / (p_partkey % 5) end, 6) as original from m""")
def angle_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, factor = F.col("p_size") / 10.0, (F.col("p_partkey") % 5).cast("double")
    return _part(spark, sf_dir).select("p_partkey", _r(geo.wrap_turn(x)).alias("turn"), _r(geo.wrap_half_turn(x)).alias("half"), _r(boxes.original_pixels(F.col("p_size") * 3.7, factor)).alias("original"))


@query("""with m as (select p_partkey, p_size / 10.0 as a, p_size / 25.0 as b, p_retailprice as t0, p_retailprice / 2 as t1 from part), d as (select *, a * a + b * b as det from m)
select p_partkey, round(a / det, 6) as a00, round(b / det, 6) as a01, round(-(a / det * t0 + b / det * t1), 4) as b0, round(-(-b / det * t0 + a / det * t1), 4) as b1 from d""")
def affine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size") / 10.0, F.col("p_size") / 25.0
    back = geo.invert_affine_2d(a, -b, b, a, F.col("p_retailprice"), F.col("p_retailprice") / 2)
    return _part(spark, sf_dir).select("p_partkey", _r(back["a00"]).alias("a00"), _r(back["a01"]).alias("a01"), _r(back["b0"], 4).alias("b0"), _r(back["b1"], 4).alias("b1"))


@query(f"""select p_partkey, round((p_size + 4) / (p_size + 1 + 1e-8), 6) as aspect_ratio, round(least(1.0, 4 * {_PI} * p_retailprice / ((p_size * 4.0) * (p_size * 4.0) + 1e-8)), 6) as circularity,
round(2 * 0.5 * sqrt(p_retailprice / {_PI}), 6) as equiv_diameter_um, concat(p_size, 'x', p_partkey % 9, 'x7') as shape from part""")
def morphology_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    found = boxes.morphology(F.col("p_retailprice"), size * 4.0, size + 4.0, size + 1.0, 0.5)
    return _part(spark, sf_dir).select("p_partkey", *[_r(c).alias(n) for n, c in found.items()], boxes.shape_label(size, F.col("p_partkey") % 9, F.lit(7)).alias("shape"))


@query(f"with {_REF}, q as (select pid, y * 1.01 + 0.5 as y, x * 0.99 - 0.5 as x from ref where pid % 400 = 1), d as (select q.pid as i, min(sqrt((r.y - q.y) * (r.y - q.y) + (r.x - q.x) * (r.x - q.x))) as dist from q, ref r group by q.pid) select i, round(dist, 6) as dist, dist <= 2 as inlier from d")
def nearest_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest reference point of each point, however far, and whether it counts as an inlier."""
    p = reference_points(spark, sf_dir)
    moved = p.filter("pid % 400 = 1").select(F.col("pid").alias("i"), (F.col("y") * 1.01 + 0.5).alias("y"), (F.col("x") * 0.99 - 0.5).alias("x"))
    near = sp.knn_join(moved, p.withColumnRenamed("pid", "j"), 1)
    return near.select("i", _r("dist").alias("dist"), (F.col("dist") <= 2).alias("inlier"))


@query(f"with {_REF}, {_knn(4)} select i, min_by(j, (dist, j)) as j, round(min(dist), 6) as dist from knn where j % 2 = 0 and dist <= 6 group by i")
def nearest_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each point's candidates (its four neighbours with an even id) the nearest within six."""
    p = reference_points(spark, sf_dir)
    allowed = neighbours(p, 4).filter("j % 2 = 0").select("i", "j")
    found = sp.nearest_allowed(p.withColumnRenamed("pid", "i"), p.withColumnRenamed("pid", "j"), allowed, 6.0)
    return found.select("i", "j", _r("dist").alias("dist"))


@query("select m as matcher, b as box_id, e as missed_pct, 's' || e || '_' || b as job from (values ('triangles'), ('hashing'), ('quad')) as ms(m), range(0, 16) as bs(b), (values (0), (20), (80)) as es(e)")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = analytics.patch_grid(100, 100, 25, 25, spark)
    jobs = analytics.job_grid(patches.select("box_id"), {"matcher": ["triangles", "hashing", "quad"], "missed_pct": [0, 20, 80]})
    return jobs.withColumn("job", F.concat(F.lit("s"), "missed_pct", F.lit("_"), "box_id"))


@query("with v as (select l_orderkey, l_linenumber, l_extendedprice as v from lineitem), e as (select min(v) as low, max(v) as high from v) select l_orderkey, l_linenumber, floor((v - low) / (high - low) * 65535)::int as value from v, e")
def pixels_uint16(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("value"))
    return raster.as_uint16(pixels)


_COS, _SIN = (f(math.radians(TRUTH_2D["angle_deg"])) for f in (math.cos, math.sin))


@query(f"""with {_REF}, n as (select count(*) as n from ref where y >= {QUERY_BOX[0]} and y < {QUERY_BOX[1]} and x >= {QUERY_BOX[0]} and x < {QUERY_BOX[1]})
select 'triangles' as matcher, 1 as attempts, 1.25::double as scale, 18.0::double as t0, -12.0::double as t1, round(1.25 * 0.5 / 0.8 * {_COS!r}, 4) as a00, round(-1.25 * 0.5 / 0.8 * {_SIN!r}, 4) as a01, 22.5::double as b0, n as n_inliers, 0 as problems, '[1] triangles, found, 1.000 inliers, 0.000 um' as line from n""")
def adaptive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adaptive run whose history, transform and summary are read back from the files that it wrote."""
    path = scratch_path(spark, "run")
    options = {"order": ["triangles", "hashing"], "over": {"n_iters": 1500, "inlier_radius_um": 0.5}}
    flow.adaptive_export(query_points(spark, sf_dir), reference_points(spark, sf_dir), path, 0.5, 0.8, (200, 200), (1300, 1300), **options)
    history = spark.read.schema("attempt int, matcher string, success boolean, frac_inliers double, mean_error_um double").json(f"{path}/history")
    short = spark.read.schema("best_scale double, best_t_um array<double>").json(f"{path}/summary")
    schema = records.FIELDS_2D.replace("match_quality struct<", "match_quality struct<n_inliers:bigint,")
    found = spark.read.schema(schema).json(f"{path}/transforms").withColumn("problems", F.size(records.problems_2d()))
    a, b, t = F.col("A_px"), F.col("b_px"), F.col("best_t_um")
    tally = history.agg(F.count(F.lit(1)).cast("int").alias("attempts"))
    lines = flow.attempt_line(history).select("line")
    one = found.crossJoin(short).crossJoin(tally).crossJoin(lines)  # one row each
    return one.select("matcher", "attempts", _r(F.col("best_scale"), 4).alias("scale"), _r(t[0], 2).alias("t0"), _r(t[1], 2).alias("t1"), _r(a[0][0], 4).alias("a00"), _r(a[0][1], 4).alias("a01"), _r(b[0], 2).alias("b0"), F.col("match_quality.n_inliers").alias("n_inliers"), "problems", "line")


@query("select p_partkey, p_size from part where not (p_size % 3 = 0 and p_partkey % 2 = 0)")
def resume_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that the results in CSV files lack; a result without a number of points isn't one."""
    jobs, path = _part(spark, sf_dir).select("p_partkey", "p_size"), scratch_path(spark, "results")
    done = jobs.filter("p_size % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("n_points"))
    done.write.option("header", True).csv(path)
    stored = flow.stored_results(spark, path, ["p_partkey", "n_points"]).filter("n_points is not null")
    return analytics.unfinished(jobs, stored.select(F.col("p_partkey").cast(jobs.schema["p_partkey"].dataType)), ["p_partkey"])
