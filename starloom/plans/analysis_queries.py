"""Queries on benchmark tables, records, text values, pixel tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.operators import analytics as an
from starloom.operators import raster, stats
from starloom.plans.catalog import query
from starloom.plans.matching import register
from starloom.session import read_table, scratch_path
from starloom.sources import records
from starloom.sources.points import QUERY_BOX, QUERY_BOX_3D, TRUTH_2D, TRUTH_3D, coordinate, query_points, query_points_3d, reference_points
from starloom.streaming import registration as streaming


def _r(c, n: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# --- benchmark tables: jobs made of line items -----------------------------------------------

_JOBS = """jobs as (select l_orderkey, l_linenumber, l_shipmode_ as matcher, n_nuclei, l_tax < 0.07 as success, frac_inliers, l_quantity as trans_error_px, ssim, err from (
 select *, case l_suppkey % 4 when 0 then 'graph' when 1 then 'quad' when 2 then 'triangles' else 'hashing' end as l_shipmode_, 3 + (l_partkey * l_partkey) % 997 as n_nuclei,
  case when l_partkey % 13 = 0 then null else 1 - l_discount * 3 end as frac_inliers, case when l_partkey % 17 = 0 then null else 1 - l_tax * 2 end as ssim, (l_suppkey % 5) * 20 as err from lineitem)),
scored as (select *, coalesce(success and frac_inliers >= 0.8 and trans_error_px < 20 and ssim >= 0.8, false) as passed from jobs)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job a line item; a missing measure is NaN, as in tables written by other tools."""
    nan = F.lit(float("nan"))
    key, part = F.col("l_suppkey"), F.col("l_partkey")
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(key % 4 == 0, "graph").when(key % 4 == 1, "quad").when(key % 4 == 2, "triangles").otherwise("hashing").alias("matcher"),
        (3 + part * part % 997).alias("n_nuclei"), (F.col("l_tax") < 0.07).alias("success"), F.when(part % 13 == 0, nan).otherwise(1 - F.col("l_discount") * 3).alias("frac_inliers"),
        F.col("l_quantity").alias("trans_error_px"), F.when(part % 17 == 0, nan).otherwise(1 - F.col("l_tax") * 2).alias("ssim"), (key % 5 * 20).alias("err"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.scored(_jobs(spark, sf_dir))


_EDGES = [3, 10, 30, 100, 300, 1000]
_CURVE = """binned as (select *, case when n_nuclei <= 10 then 0 when n_nuclei <= 30 then 1 when n_nuclei <= 100 then 2 when n_nuclei <= 300 then 3 else 4 end as bin from scored),
curve as (select matcher, bin, count(*) as n, sum(passed::int)::bigint as n_passed, sum(passed::int) / count(*) as p, avg(n_nuclei) as mean_n from binned group by 1, 2)"""


@query(f"with {_JOBS} select l_orderkey, l_linenumber, matcher, passed from scored")
def bench_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "matcher", "passed")


@query(f"""with {_JOBS}, {_CURVE} select matcher, bin, n, n_passed, round(p, 6) as p,
 round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as p_low,
 round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as p_high, round(mean_n, 6) as mean_n from curve""")
def bench_bins_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = an.success_by_bin(_scored(spark, sf_dir), _EDGES)
    return curve.select("matcher", "bin", "n", "n_passed", *[_r(c).alias(c) for c in ("p", "p_low", "p_high", "mean_n")])


@query(f"""with {_JOBS}, {_CURVE}, held as (select *, min(p) over (partition by matcher order by mean_n rows between current row and unbounded following) as least_p from curve)
select matcher, round(min(case when least_p >= 0.1 then mean_n end), 6) as threshold from held group by matcher""")
def threshold_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = an.success_by_bin(_scored(spark, sf_dir), _EDGES)
    return an.sustained_threshold(curve, 0.1).withColumn("threshold", _r("threshold"))


@query(f"with {_JOBS}, c as (select matcher, err, avg(passed::int) as p from scored group by 1, 2) select matcher, max(case when p >= 0.1 then err end) as tolerance from c group by matcher")
def error_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _scored(spark, sf_dir).groupBy("matcher", "err").agg(F.avg(F.col("passed").cast("int")).alias("p"))
    return an.error_tolerance(curve, 0.1, ["matcher"], "err")


@query(f"with {_JOBS}, c as (select matcher, err, avg(passed::int) as p from scored group by 1, 2) select err, matcher, round(p, 6) as p from c qualify row_number() over (partition by err order by p desc nulls last, matcher) = 1")
def best_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _scored(spark, sf_dir).groupBy("matcher", "err").agg(F.avg(F.col("passed").cast("int")).alias("p"))
    return an.best_by_group(curve, "p", "matcher", ["err"]).withColumn("p", _r("p"))


@query(f"""with {_JOBS} select matcher, err, count(*) as n_rows, count(ssim) as n_values, round(avg(ssim), 6) as mean, round(quantile_cont(ssim, 0.5), 6) as "median", round(quantile_cont(ssim, 0.25), 6) as q25,
 round(quantile_cont(ssim, 0.75), 6) as q75, round(min(ssim), 6) as lowest, round(max(ssim), 6) as highest from jobs group by 1, 2""")
def group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = an.group_summary(_jobs(spark, sf_dir), "ssim", ["matcher", "err"])
    return out.select("matcher", "err", "n_rows", "n_values", *[_r(c).alias(c) for c in ("mean", "median", "q25", "q75", "lowest", "highest")])


_REASON = "case when not success then 'matcher' when frac_inliers is null then null when frac_inliers < 0.8 then 'inliers' else 'other' end"


@query(f"with {_JOBS} select matcher, coalesce({_REASON}, 'unknown') as failure_reason, count(*) as n from scored where not passed group by 1, 2")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(~F.isnan("frac_inliers"), F.col("frac_inliers"))
    reason = F.when(~F.col("success"), "matcher").when(known.isNull(), F.lit(None)).when(known < 0.8, "inliers").otherwise("other")
    return an.failure_histogram(_scored(spark, sf_dir).withColumn("failure_reason", reason), ["matcher"])


@query(f"with {_JOBS} select err, count(*) filter (matcher = 'graph') as graph, count(*) filter (matcher = 'quad') as quad, count(*) filter (matcher = 'triangles') as triangles, count(*) filter (matcher = 'hashing') as hashing from jobs group by err")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.coverage(_jobs(spark, sf_dir), "err", "matcher", ["graph", "quad", "triangles", "hashing"])


@query("select o_orderkey, o_custkey from orders where (o_custkey, o_orderdate) in (select (o_custkey, o_orderdate) from orders group by o_custkey, o_orderdate having count(*) > 1)")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.repeated_rows(read_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"]).select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return an.unfinished(read_table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_per_key(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("select l_linenumber, count(*) as n from lineitem group by 1 order by n desc, l_linenumber limit 1")
def mode_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.most_populated(read_table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("""select p_partkey, case when p_size % 5 = 0 then -1e12 + 100 * (p_size / 50.0) else 1000 * (p_size / 50.0) - p_retailprice / 1000 - 0.05 * (p_partkey % 60) end as score from (select p_partkey, p_size::double as p_size, p_retailprice from part)""")
def score_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return read_table(spark, sf_dir, "part").select("p_partkey", an.attempt_score(F.col("p_size") % 5 != 0, size / 50.0, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 60).cast("double")).alias("score"))


@query("select y * 9 + x as box_id, y * 100 as y0, y * 100 + 200 as y1, x * 100 as x0, x * 100 + 200 as x1 from range(9) a(y), range(9) b(x)")
def patch_plan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.patch_grid(1000, 1000, 200, 100, spark)


_U = "((({k}) * ({k}) * 7919 + ({k}) * 104729 + {s} * 15487) % 1000003) / 1000003.0"
_Y = "cast((o_orderkey * o_orderkey * 7919 + o_orderkey * 104729 + 12345) % 100003 as double) / 100"


@query(f"""select o_orderkey as pid, round({_Y}, 6) as y, false as fake from orders where {_U.format(k='o_orderkey', s=3)} >= 0.4
union all select -i - 1, round(1000 * ({_U.format(k='i + 1', s=4)}), 6), true from range((select round_even(count(*) * 0.1, 0)::bigint from orders)) t(i)""")
def perturbed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = an.perturbed(reference_points(spark, sf_dir), 0.4, 0.1, (0.0, 1000.0, 0.0, 1000.0), seed=3)
    return out.select("pid", _r("y").alias("y"), "fake")


@query("select p_partkey, round(1 / (1 + exp(-6.0 * (log10(p_size + 1) - 1.2))), 6) as p from part")
def logistic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", _r(stats.logistic_success(F.col("p_size") + 1, 6.0, 1.2)).alias("p"))


# --- text values and records ---------------------------------------------------------------------


@query("""select event_id, case trim(lower(n)) when 'tri' then 'triangles' when 'tris' then 'triangles' when 'triangle' then 'triangles' else lower(trim(n)) end as matcher, lower(trim(b)) in ('true', '1', 'yes', 'y') as truth,
 case when t = 'x' then null else try_cast(t as double) end as number, round(q, 6) as quotient, round(u, 6) as um from (
 select event_id, case event_id % 4 when 0 then ' Tri ' when 1 then 'TRIS' when 2 then 'Quad' else 'graph' end as n, case event_id % 3 when 0 then ' Yes' when 1 then 'no' else '1' end as b, case event_id % 5 when 0 then 'x' else (event_id % 5)::varchar end as t,
 case event_id % 3 when 0 then 300.0 / ((event_id % 9) + 1) when 1 then null else 2.5 end as q, case event_id % 3 when 0 then value * 1000 when 1 then value * 0.001 else value * 25400 end as u from events)""")
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read_table(spark, sf_dir, "events"), F.col("event_id")
    name = F.when(k % 4 == 0, " Tri ").when(k % 4 == 1, "TRIS").when(k % 4 == 2, "Quad").otherwise("graph")
    flag = F.when(k % 3 == 0, " Yes").when(k % 3 == 1, "no").otherwise("1")
    digits = F.when(k % 5 == 0, "x").otherwise((k % 5).cast("string"))
    fraction = F.when(k % 3 == 0, F.concat(F.lit("300/"), (k % 9 + 1).cast("string"))).when(k % 3 == 1, "7/0").otherwise("2.5")
    unit = F.when(k % 3 == 0, "mm").when(k % 3 == 1, "nm").otherwise("Inch")
    return e.select("event_id", tx.matcher_name(name).alias("matcher"), tx.truthy(flag).alias("truth"), tx.number(digits).alias("number"), _r(tx.ratio(fraction)).alias("quotient"), _r(tx.to_um(F.col("value"), unit)).alias("um"))


@query("""select r_regionkey, 97780135 as seed from region where r_name = 'AFRICA'""")
def adler32_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "region").filter("r_name = 'AFRICA'").select("r_regionkey", tx.adler32(F.col("r_name")).cast("int").alias("seed"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record text for each event, some of them wrong."""
    k = F.col("event_id")
    text = F.concat(
        F.lit('{"matcher":"'), F.col("event_type"), F.lit('","success":'), F.when(k % 7 == 0, "false").otherwise("true"), F.lit(',"scale":'), F.when(k % 11 == 0, "-1.0").otherwise("1.25"),
        F.lit(',"R_yx":[[1.0,0.0],[0.0,1.0]],"t_um_yx":'), F.when(k % 13 == 0, "[1.0]").otherwise("[1.0,2.0]"), F.lit(',"pixel_size_crop_um":'), F.when(k % 17 == 0, "0.0").otherwise("0.5"), F.lit(',"pixel_size_full_um":'), F.when(k % 3 == 0, "0.51").otherwise("0.5"),
        F.lit(',"match_quality":{"success":true,"frac_inliers":'), ((k % 10) / 10.0).cast("string"), F.lit(',"mean_error_um":0.5},"future_field":1}'),
    )
    rows = read_table(spark, sf_dir, "events").select("event_id", "event_type", k.cast("int").alias("_line"), F.lit("events").alias("_source_path"), text.alias("_text"))
    return records.parsed(rows, records.FIELDS_2D)


@query("""select event_id, (case when event_id % 7 = 0 then 1 else 0 end + case when event_id % 11 = 0 then 1 else 0 end + case when event_id % 13 = 0 then 1 else 0 end + case when event_id % 17 = 0 then 1 else 0 end)::int as n_problems,
 event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0 as ok from events""")
def records_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = records.problems_2d()
    return _records(spark, sf_dir).select("event_id", F.size(bad).alias("n_problems"), (F.size(bad) == 0).alias("ok"))


@query("""select event_id, round(case when event_id % 3 = 0 then 0.02 else 0 end, 6)::double as penalty from events where event_id % 7 <> 0 order by penalty, -(event_id % 10) , event_id limit 20""")
def records_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.ranked(_records(spark, sf_dir), [(F.col("pixel_size_full_um"), F.lit(0.5))])
    return out.limit(20).select("event_id", _r("penalty").alias("penalty"))


@query("""select c_custkey, 1.5::double as scale, 3.0::double as a00, round(c_acctbal / 0.5, 6) as b0, null::varchar as problem from customer""")
def records_alias_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"best_scale":1.5,"best_R":[[1.0,0.0,0.0],[0.0,1.0,0.0],[0.0,0.0,1.0]],"best_t":['), F.col("c_acctbal").cast("string"), F.lit(',0.0,0.0],"voxel_size_full_um_zyx":[0.5,0.5,0.5],"pixel_size_patch_um_zyx":[1.0,0.5,0.5]}'))
    rows = records.canonical_3d(records.parsed(read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("_text")), records.FIELDS_3D))
    return rows.select("c_custkey", "scale", F.col("A_px")[0][0].alias("a00"), _r(F.col("b_px")[0]).alias("b0"), records.problem_3d().alias("problem"))


# --- pixel tables ----------------------------------------------------------------------------------

_PX = "px as (select (o_orderkey // 125)::int as y, (o_orderkey % 125)::int as x, ((o_orderkey * o_orderkey * 7919 + o_orderkey * 104729) % 1000) / 10.0 as val from orders)"
_LAB = "lab as (select y, x, (case when y % 10 < 7 and x % 12 < 9 then (y // 10) * 100 + x // 12 + 1 else 0 end)::int as label from px)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(F.floor(k / 125).cast("int").alias("y"), (k % 125).cast("int").alias("x"), ((k * k * 7919 + k * 104729) % 1000 / 10.0).alias("val"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    inside = (y % 10 < 7) & (x % 12 < 9)
    return _pixels(spark, sf_dir).select("y", "x", F.when(inside, F.floor(y / 10) * 100 + F.floor(x / 12) + 1).otherwise(0).cast("int").alias("label"))


@query(f"with {_PX}, {_LAB} select label, count(*) as area, round(avg(y), 6) as cy, round(avg(x), 6) as cx, min(y) as y0, max(y) + 1 as y1, min(x) as x0, max(x) + 1 as x1, round(count(*) / ((max(y) + 1 - min(y)) * (max(x) + 1 - min(x))), 6) as extent from lab where label > 0 group by label")
def label_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raster.label_measures(_labels(spark, sf_dir))
    return m.select("label", "area", _r("cy").alias("cy"), _r("cx").alias("cx"), "y0", "y1", "x0", "x1", _r("extent").alias("extent"))


@query(f"""with {_PX}, b as (select quantile_cont(val, 0.02) as lo, quantile_cont(val, 0.98) as hi from px) select y, x, round(greatest(0, least(1, (val - lo) / (hi - lo))), 6) as val from px, b""")
def percentile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.percentile_normalised(_pixels(spark, sf_dir)).withColumn("val", _r("val"))


@query(f"with {_PX} select y, max(val) as val from px where y % 2 = 0 group by y")
def max_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.max_projection(_pixels(spark, sf_dir), ("y",), 2)


@query(f"""with {_PX}, g as (select (i // 60)::int as y, (i % 60)::int as x, 1.5 * (i // 60) + 0.25 as sy, 1.25 * (i % 60) + 3.5 as sx from range(2400) t(i)),
s as (select g.y, g.x, floor(sy)::int + a.o as py, floor(sx)::int + b.o as px_, (case when a.o = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case when b.o = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w from g, (values (0), (1)) a(o), (values (0), (1)) b(o))
select s.y, s.x, round(sum(w * coalesce(val, 0)), 6) as val from s left join px on px.y = py and px.x = px_ group by 1, 2""")
def warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    inverse = {"a00": 1.5, "a01": 0.0, "a10": 0.0, "a11": 1.25, "b0": 0.25, "b1": 3.5}
    return raster.warped(_pixels(spark, sf_dir), inverse, 40, 60).withColumn("val", _r("val"))


@query(f"with {_PX}, {_LAB} select min(y * 1048576::bigint + x) as label, count(*) as n from lab where label > 0 group by lab.label having count(*) >= 30")
def connected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = _labels(spark, sf_dir).filter("label > 0").select("y", "x")
    return raster.label_components(mask, min_size=30).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_PX}, m as (select min(val) as a, (max(val) - min(val)) / 256 as w from px), h as (select least(floor((val - a) / w), 255)::int as k, count(*) as n from px, m group by 1),
f as (select i as k, coalesce(n, 0) as n, a + (i + 0.5) * w as c from range(256) t(i) left join h on h.k = i, m),
s as (select k, c, sum(n) over (order by k) as w1, sum(n * c) over (order by k) as s1, sum(n) over () as wt, sum(n * c) over () as st from f)
select round(arg_max(c, w1 * (wt - w1) * (s1 / w1 - (st - s1) / (wt - w1)) ** 2), 6) as threshold from s where w1 > 0 and w1 < wt""")
def otsu_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(raster.otsu_threshold(_pixels(spark, sf_dir)),)], "threshold double").withColumn("threshold", _r("threshold"))


@query("select 1.0::double as ssim")
def ssim_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.percentile_normalised(_pixels(spark, sf_dir))
    return raster.structural_similarity(p, p).select(_r("ssim").alias("ssim"))


@query()
def stitch_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slices whose labels drift by two pixels: sizes of the stitched labels."""
    lab = _labels(spark, sf_dir)
    slices = lab.select("y", "x", "label", F.explode(F.array(*[F.lit(z) for z in range(3)])).alias("z")).select("z", (F.col("y") + F.col("z") * 2).alias("y"), "x", F.when(F.col("label") > 0, F.col("label") * (F.col("z") + 1)).otherwise(0).alias("label"))
    return raster.stitch_slices(slices, 0.25).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("z").alias("n_slices"))


# --- whole registrations and streams ------------------------------------------------------------------

_MATCH = {"triangles": {"n_iters": 1500}, "hashing": {}, "quad": {"max_candidate_pairs": 300, "n_quads_per_center": 4}, "graph": {"n_iters": 1500}}


def _result(spark: SparkSession, row: dict, n: int, good: bool) -> DataFrame:
    return spark.createDataFrame([(row["matcher"], good, n, row["n_inliers"], row["frac_inliers"])], "matcher string, recovered boolean, n_points long, n_inliers long, frac_inliers double")


def _match_sql(matcher: str, dims: int = 2) -> str:
    """Query points are those of a box, so a recovered map brings all of them to a reference point."""
    axes, boxes = ("yx", [QUERY_BOX] * 2) if dims == 2 else ("zyx", QUERY_BOX_3D)
    box = " and ".join(f"{d} >= {low} and {d} < {high}" for d, (low, high) in zip(axes, boxes, strict=True))
    ref = ", ".join(f"{coordinate(d, 'o_orderkey')} as {d}" for d in axes)
    return f"select '{matcher}' as matcher, true as recovered, count(*) as n_points, count(*) as n_inliers, count(*) / count(*) as frac_inliers from (select {ref} from orders) where {box}"


def _match(spark: SparkSession, sf_dir: str, matcher: str) -> DataFrame:
    reference, asked = reference_points(spark, sf_dir), query_points(spark, sf_dir)
    row = register(asked, reference, matcher, {**_MATCH[matcher], "inlier_radius_um": 0.5})
    good = bool(row["success"]) and abs(row["scale"] / TRUTH_2D["scale"] - 1) < 0.03 and abs(row["t0"] - TRUTH_2D["t0"]) < 2.5 and abs(row["t1"] - TRUTH_2D["t1"]) < 2.5
    return _result(spark, row, asked.count(), good)


@query(_match_sql("hashing"))
def match_hashing_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "hashing")


@query(_match_sql("triangles"))
def match_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "triangles")


@query(_match_sql("quad"))
def match_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "quad")


@query(_match_sql("graph"))
def match_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "graph")


_MATCH_3D = {"pyramid": {"n_iters": 2000}, "hashing": {"base_distance_um": 60.0, "min_inliers_abs": 8}}


def _match_3d(spark: SparkSession, sf_dir: str, matcher: str) -> DataFrame:
    reference, asked = reference_points(spark, sf_dir, ("z", "y", "x")), query_points_3d(spark, sf_dir)
    row = register(asked, reference, matcher, {**_MATCH_3D[matcher], "inlier_radius_um": 2.0}, dims=3)
    good = bool(row["success"]) and abs(row["scale"] / TRUTH_3D["scale"] - 1) < 0.04 and all(abs(row[f"t{k}"] - TRUTH_3D[f"t{k}"]) < 3 for k in range(3))
    return _result(spark, row, asked.count(), good)


@query(_match_sql("pyramid", 3))
def match_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match_3d(spark, sf_dir, "pyramid")


@query(_match_sql("hashing", 3))
def match_hashing_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match_3d(spark, sf_dir, "hashing")


@query("select count(*) as n, count(*) as n_inliers from orders")
def stream_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as files in a folder, matched batch by batch as they arrive."""
    path, reference = scratch_path(spark, "stream"), reference_points(spark, sf_dir)
    reference.select(F.concat(F.lit("set"), (F.col("pid") % 7).cast("string")).alias("set_id"), "pid", "y", "x").repartition(4, "set_id").write.json(f"{path}/in")
    act = streaming.append_results(f"{path}/out", reference, 0.5)
    streaming.register_stream(streaming.stream_points(spark, f"{path}/in", files_per_batch=2), act, f"{path}/state").awaitTermination()
    return spark.read.schema("n long, n_inliers long").json(f"{path}/out").agg(F.sum("n").alias("n"), F.sum("n_inliers").alias("n_inliers"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.windowed_counts(read_table(spark, sf_dir, "events")).withColumn("mean", _r("mean"))
