"""Queries on point sets: projections, filters, neighbour joins, descriptors, hash tables, maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import geometry as geo
from starloom.operators import hashing, stats
from starloom.operators import neighbours as nb
from starloom.operators import registration as reg
from starloom.operators import spatial as sp
from starloom.plans.catalog import query
from starloom.session import read_table
from starloom.sources.points import AXES, QUERY_BOX, TRUTH_2D, query_points, reference_points

ZYX = ("z", "y", "x")


def _axis(d: str) -> str:
    a, b, c, m = AXES[d]
    return f"cast((o_orderkey * o_orderkey * {a} + o_orderkey * {b} + {c}) % {m} as double) / 100 as {d}"


_REF = f"ref as (select o_orderkey as pid, {_axis('y')}, {_axis('x')} from orders)"
_REF3 = f"ref as (select o_orderkey as pid, {_axis('z')}, {_axis('y')}, {_axis('x')} from orders)"


def _pairs(width: float, dims: str = "yx", left: str = "ref", right: str = "ref", limit: float | None = None, same: bool = False, name: str = "pairs") -> str:
    """Pairs up to a distance, by cells, as in any engine."""
    dist = "sqrt(" + " + ".join(f"(a.{d} - b.{d}) * (a.{d} - b.{d})" for d in dims) + ")"
    cells = " and ".join(f"b.c{d} = a.c{d} + s{d}.o" for d in dims)
    shifts = ", ".join(f"(values (-1), (0), (1)) s{d}(o)" for d in dims)
    put = ", ".join(f"cast(floor({d} / {width}) as bigint) as c{d}" for d in dims)
    other = "" if same else "and a.pid <> b.pid"
    return f"""cl as (select *, {put} from {left}), cr as (select *, {put} from {right}),
{name} as (select a.pid as i, b.pid as j, {dist} as dist from cl a, {shifts}, cr b where {cells} {other} and {dist} <= {limit or width})"""


def _knn(k: int, dims: str = "yx", width: float = 60.0, left: str = "ref", right: str = "ref", same: bool = False) -> str:
    return _pairs(width, dims, left, right, same=same, name="near") + f""",
knn as (select *, row_number() over (partition by i order by dist, j) as rank from near qualify rank <= {k})"""


def _r(c, n: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# --- projections, filters -------------------------------------------------------------------


@query(f"with {_REF3} select pid, round(z, 6) as z, round(y, 6) as y, round(x, 6) as x from ref")
def points_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_points(spark, sf_dir, ZYX).select("pid", *[_r(d).alias(d) for d in ZYX])


@query("""select l_orderkey, l_linenumber, round(v, 4) as v from (select *, case when l_quantity > 45 then null else l_extendedprice / (l_quantity + 0.37) end as v from lineitem) where v is not null""")
def points_finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / (F.col("l_quantity") + 0.37)).alias("v"))
    return sp.finite_points(rows, ["v"]).withColumn("v", _r("v", 4))


@query("select p_partkey, p_size from part where p_size between 9 and 36")
def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").filter(F.col("p_size").between(9, 36)).select("p_partkey", "p_size")


@query("""with b as (select p_partkey, p_partkey % 97 as r0, p_partkey % 97 + p_size % 7 + 1 as r1, p_partkey % 89 as c0, p_partkey % 89 + p_size % 5 + 1 as c1 from part)
select p_partkey, r0, r1, c0, c1 from b where not (r0 <= 2 or c0 <= 2 or r1 >= 98 or c1 >= 88)""")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    boxes = part.select("p_partkey", (F.col("p_partkey") % 97).alias("r0"), (F.col("p_partkey") % 97 + F.col("p_size") % 7 + 1).alias("r1"), (F.col("p_partkey") % 89).alias("c0"), (F.col("p_partkey") % 89 + F.col("p_size") % 5 + 1).alias("c1"))
    margin, height, width = 2, 100, 90
    return boxes.filter(~((F.col("r0") <= margin) | (F.col("c0") <= margin) | (F.col("r1") >= height - margin) | (F.col("c1") >= width - margin)))


# --- neighbour joins -------------------------------------------------------------------------


@query(f"with {_REF}, {_knn(4)} select i, j, rank, round(dist, 6) as dist from knn")
def knn_self_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.neighbours(reference_points(spark, sf_dir), 4).select("i", "j", F.col("rank").cast("long").alias("rank"), _r("dist").alias("dist"))


@query(f"with {_REF3}, {_knn(3, 'zyx', 160.0)} select i, j, rank, round(dist, 6) as dist from knn")
def knn_self_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.neighbours(reference_points(spark, sf_dir, ZYX), 3, ZYX).select("i", "j", F.col("rank").cast("long").alias("rank"), _r("dist").alias("dist"))


@query(f"with {_REF}, {_knn(3)} select i as pid, round(max(case when rank = 1 then dist end), 6) as nn1, round(max(case when rank = 2 then dist end), 6) as nn2, round(max(case when rank = 3 then dist end), 6) as nn3 from knn group by i")
def nn_columns_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nb.neighbours(reference_points(spark, sf_dir), 3)
    return near.groupBy(F.col("i").alias("pid")).agg(*[_r(F.max(F.when(F.col("rank") == k, F.col("dist")))).alias(f"nn{k}") for k in (1, 2, 3)])


@query(f"with {_REF}, {_pairs(20.0)} select r.pid, count(p.i) as density from ref r left join pairs p on p.i = r.pid group by r.pid")
def local_density_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.local_density(reference_points(spark, sf_dir), 20.0)


@query(f"with {_REF}, {_pairs(5.0)} select i, j, round(dist, 6) as dist from pairs")
def radius_join_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    return sp.radius_join(p.withColumnRenamed("pid", "i"), None, 5.0, skip_same_id=True).withColumn("dist", _r("dist"))


@query(f"with {_REF3}, {_pairs(25.0, 'zyx')} select i, j, round(dist, 6) as dist from pairs")
def radius_join_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir, ZYX)
    return sp.radius_join(p.withColumnRenamed("pid", "i"), None, 25.0, ZYX, skip_same_id=True).withColumn("dist", _r("dist"))


_MOVED = "moved as (select pid, y + ((pid * 31) % 7 - 3) / 10.0 as y, x + ((pid * 17) % 5 - 2) / 10.0 as x from ref)"


def _moved(points: DataFrame) -> DataFrame:
    return points.select("pid", (F.col("y") + (F.col("pid") * 31 % 7 - 3) / 10.0).alias("y"), (F.col("x") + (F.col("pid") * 17 % 5 - 2) / 10.0).alias("x"))


@query(f"with {_REF}, {_MOVED}, {_pairs(3.0, left='moved', same=True)} select i, arg_min(j, (dist, j)) as j, round(min(dist), 6) as dist from pairs group by i")
def nearest_within_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    return sp.nearest_within(_moved(p).withColumnRenamed("pid", "i"), p.withColumnRenamed("pid", "j"), 3.0).withColumn("dist", _r("dist"))


@query(f"""with {_REF}, {_MOVED}, {_pairs(3.0, left='moved', same=True)}, best as (select i, arg_min(j, (dist, j)) as j, min(dist) as dist from pairs group by i)
select arg_min(i, (dist, i)) as i, j, round(min(dist), 6) as dist from best group by j""")
def unique_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    near = sp.nearest_within(_moved(p).withColumnRenamed("pid", "i"), p.withColumnRenamed("pid", "j"), 3.0)
    return sp.one_to_one(near).withColumn("dist", _r("dist"))


_EDGES = "edges as (select least(i, j) as i, greatest(i, j) as j, min(dist) as dist from knn where dist >= 1e-6 group by 1, 2)"
_ADJ = "adj as (select i, j, dist, row_number() over (partition by i order by dist, j) as rank from (select i, j, dist from edges union all select j, i, dist from edges))"


@query(f"with {_REF}, {_knn(5)}, {_EDGES} select i, j, round(dist, 6) as dist from edges")
def knn_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.knn_edges(nb.neighbours(reference_points(spark, sf_dir), 5)).withColumn("dist", _r("dist"))


@query(f"with {_REF}, {_knn(5)}, {_EDGES}, {_ADJ} select i, count(*) as degree, round(median(dist), 6) as middle from adj group by i")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = nb.adjacency(nb.knn_edges(nb.neighbours(reference_points(spark, sf_dir), 5)))
    return adj.groupBy("i").agg(F.count(F.lit(1)).alias("degree"), _r(F.percentile("dist", 0.5)).alias("middle"))


@query(f"with {_REF}, {_knn(5)}, {_EDGES}, {_ADJ} select i, string_agg(j::varchar, ',' order by rank) as partners from adj group by i")
def adjacency_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = nb.adjacency(nb.knn_edges(nb.neighbours(reference_points(spark, sf_dir), 5)))
    return adj.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "j"))), lambda s: s["j"].cast("string")), ",").alias("partners"))


_FEATURE_KNN = """near as (select a.vec_id as i, b.vec_id as j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) ** 2))) as dist
  from embeddings a, embeddings b where a.vec_id % 20 = 0),
knn as (select *, row_number() over (partition by i order by dist, j) as rank from near qualify rank <= 10)"""


def _feature_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"), F.col("embedding").alias("f"))
    return nb.feature_knn(vectors.filter("j % 20 = 0").withColumnRenamed("j", "i"), vectors, 10)


@query(f"with {_FEATURE_KNN} select i, j, rank, round(dist, 6) as dist from knn")
def feature_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_knn(spark, sf_dir).select("i", "j", F.col("rank").cast("long").alias("rank"), _r("dist").alias("dist"))


_RATIO = "lead_of as (select i, min(case when rank = 1 then dist end) as d1, min(case when rank = 2 then dist end) as d2 from knn group by i)"


@query(f"with {_FEATURE_KNN}, {_RATIO} select k.i, k.j, k.rank from knn k join lead_of l using (i) where k.rank <= case when d2 is not null and d1 <= 0.85 * d2 then 1 else 5 end")
def ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.ratio_test(_feature_knn(spark, sf_dir), 0.85, 5).select("i", "j", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_REF}, {_MOVED}, {_knn(1, left='moved', same=True)}, ahead as (select i, j, dist from knn),
br as (select *, cast(floor(y / 60.0) as bigint) as cy, cast(floor(x / 60.0) as bigint) as cx from ref), bm as (select *, cast(floor(y / 60.0) as bigint) as cy, cast(floor(x / 60.0) as bigint) as cx from moved),
back as (select r.pid as j, m.pid as i, sqrt((r.y - m.y) * (r.y - m.y) + (r.x - m.x) * (r.x - m.x)) as d from br r, (values (-1), (0), (1)) s(o), (values (-1), (0), (1)) t(o), bm m where m.cy = r.cy + s.o and m.cx = r.cx + t.o qualify row_number() over (partition by r.pid order by d, m.pid) = 1)
select a.i, a.j, round(least(a.dist, b.d), 6) as dist from ahead a join back b on a.i = b.i and a.j = b.j""")
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    m = _moved(p)
    ahead = sp.knn_join(m.withColumnRenamed("pid", "i"), p.withColumnRenamed("pid", "j"), 1)
    back = sp.knn_join(p.withColumnRenamed("pid", "i"), m.withColumnRenamed("pid", "j"), 1).select(F.col("j").alias("i"), F.col("i").alias("j"), "dist")
    return sp.mutual_pairs(ahead, back).withColumn("dist", _r("dist"))


@query(f"""with {_REF}, boxes as (select c_custkey as box_id, (c_custkey * 37) % 900 as y0, (c_custkey * 37) % 900 + 40 as y1, (c_custkey * 53) % 900 as x0, (c_custkey * 53) % 900 + 60 as x1 from customer)
select box_id, count(*) as n_points from boxes b join ref r on r.y >= y0 and r.y < y1 and r.x >= x0 and r.x < x1 group by box_id""")
def box_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    boxes = read_table(spark, sf_dir, "customer").select(k.alias("box_id"), (k * 37 % 900).alias("y0"), (k * 37 % 900 + 40).alias("y1"), (k * 53 % 900).alias("x0"), (k * 53 % 900 + 60).alias("x1"))
    return sp.box_counts(reference_points(spark, sf_dir), boxes, 10.0)


@query(f"with {_REF3} select round(avg(z), 6) as z, round(avg(y), 6) as y, round(avg(x), 6) as x, count(*) as merged from ref group by round_even(z / 50.0, 0), round_even(y / 50.0, 0), round_even(x / 50.0, 0)")
def voxel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.merge_duplicates(reference_points(spark, sf_dir, ZYX), 50.0).select(*[_r(d).alias(d) for d in ZYX], "merged")


@query(f"with {_REF3}, {_knn(1, 'zyx', 160.0)} select i as pid from knn where dist <= (select quantile_cont(dist, 0.9) from knn)")
def far_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.drop_far_outliers(reference_points(spark, sf_dir, ZYX), 90).select("pid")


# --- statistics -------------------------------------------------------------------------------


@query("""with r as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_discount) as md, stddev_pop(l_discount) as sd from lineitem where l_returnflag = 'N')
select l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) as l_quantity, round((l_discount - md) / sd, 6) as l_discount from lineitem, r""")
def zscore_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    out = stats.zscore(rows, rows.filter("l_returnflag = 'N'"), ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", _r("l_quantity").alias("l_quantity"), _r("l_discount").alias("l_discount"))


@query("""with m as (select event_type, median(value) as mid from events group by 1)
select e.event_type, round(any_value(mid), 6) as "median", round(median(abs(value - mid)), 6) as mad from events e join m using (event_type) group by e.event_type""")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_and_mad(read_table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", _r("median").alias("median"), _r("mad").alias("mad"))


@query("""with e as (select event_id, case when user_id % 11 = 0 then null else value end as v from events) select event_id, round(coalesce(v, (select median(v) from e)), 6) as v from e""")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return stats.impute_median(rows, rows, ["v"]).withColumn("v", _r("v"))


@query(f"""with {_FEATURE_KNN}, m as (select median(dist) as mid from knn), l as (select mid + 0.5 * (select median(abs(dist - mid)) from knn) as top from m)
select i, j from knn, l where dist <= top""")
def feature_cap_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cap_by_mad(_feature_knn(spark, sf_dir), 0.5).select("i", "j")


@query(f"""with {_REF}, {_MOVED}, {_knn(1)}, s as (select median(dist) as sr from knn where dist > 0), d as (select count(*) / ((max(y) - min(y)) * (max(x) - min(x))) as dr from ref)
select 1.5::double as prior, 1.2::double as scale_min, 1.8::double as scale_max from s, d""")
def scale_prior_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    small = p.select("pid", (F.col("y") / 1.5).alias("y"), (F.col("x") / 1.5).alias("x"))
    return stats.scale_prior(small, p).select(*[_r(c).alias(c) for c in ("prior", "scale_min", "scale_max")])


@query("select 1.25::double as prior, 1.0::double as scale_min, 1.5::double as scale_max")
def scale_prior_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir, ZYX)
    small = p.select("pid", *[(F.col(d) / 1.25).alias(d) for d in ZYX])
    return stats.scale_prior(small, p, ZYX, 0.2, (0.8, 2.0), math.log(1.05)).select(*[_r(c).alias(c) for c in ("prior", "scale_min", "scale_max")])


@query("""select p_partkey, greatest(3, least(greatest(5, ceil(p_size * 0.12)::int), greatest(3, floor(p_size * 0.8)::int))) as need_2d,
 least(greatest(3, 8, floor(p_size * 0.12 + 0.5)::int), greatest(3, floor(p_size * 0.8)::int)) as need_3d from part""")
def min_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return read_table(spark, sf_dir, "part").select("p_partkey", stats.min_inliers_2d(n, 5, 0.12).alias("need_2d"), stats.min_inliers_3d(n, 8, 0.12).alias("need_3d"))


# --- descriptors and hash tables ---------------------------------------------------------------

_TRI = f"""{_REF}, {_knn(4)}, loc as (select k.i, k.j, k.rank, p.y as iy, p.x as ix, q.y as jy, q.x as jx from knn k join ref p on p.pid = k.i join ref q on q.pid = k.j),
formed as (select l.i, l.rank, a.jy - l.iy as v1y, a.jx - l.ix as v1x, l.jy - l.iy as v2y, l.jx - l.ix as v2x from loc l join loc a on a.i = l.i and a.rank = 1 where l.rank > 1),
vals as (select *, v2y * v2y + v2x * v2x as unit, v1y * v2x - v1x * v2y as crossed from formed),
d as (select i, rank, (v1y * v2y + v1x * v2x) / unit as f0, crossed / unit as f1, abs(crossed) as area2 from vals)"""


@query(f"with {_TRI} select p.pid as i, round(coalesce(avg(case when area2 >= 2e-6 then f0 end), 0), 5) as f0, round(coalesce(avg(case when area2 >= 2e-6 then f1 end), 0), 5) as f1 from ref p left join d on d.i = p.pid group by p.pid")
def triangle_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    f = nb.triangle_features(nb.neighbours(p, 4), p, 3)
    return f.select("i", _r("f0", 5).alias("f0"), _r("f1", 5).alias("f1"))


@query(f"""with {_REF3}, {_knn(4, 'zyx', 160.0)}, loc as (select k.i, k.rank, q.z - p.z as z, q.y - p.y as y, q.x - p.x as x from knn k join ref p on p.pid = k.i join ref q on q.pid = k.j),
t as (select a.i, a.rank as ra, b.rank as rb, c.rank as rc, abs(a.z * (b.y * c.x - b.x * c.y) - a.y * (b.z * c.x - b.x * c.z) + a.x * (b.z * c.y - b.y * c.z)) / 6 as vol,
  list_sort([sqrt(a.z*a.z+a.y*a.y+a.x*a.x), sqrt(b.z*b.z+b.y*b.y+b.x*b.x), sqrt(c.z*c.z+c.y*c.y+c.x*c.x), sqrt((a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2), sqrt((a.z-c.z)**2+(a.y-c.y)**2+(a.x-c.x)**2), sqrt((b.z-c.z)**2+(b.y-c.y)**2+(b.x-c.x)**2)]) as e
  from loc a join loc b on a.i = b.i and b.rank > a.rank join loc c on c.i = a.i and c.rank > b.rank),
v as (select *, list_avg(e) as m from t),
g as (select *, row_number() over (partition by i order by ra, rb, rc) as n from v where e[1] > 1e-8 and e[6] <= 50 * e[1] and vol / (m * m * m) > 1e-4)
select i, round(avg(15 * vol / (m * m * m)), 5) as shape, round(avg(e[1] / m), 5) as shortest, round(avg(e[6] / m), 5) as longest from g where n <= 3 group by i""")
def tetrahedron_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir, ZYX)
    f = nb.tetrahedron_features(nb.neighbours(p, 4, ZYX), p, 3)
    return f.select("i", _r(F.col("f")[0], 5).alias("shape"), _r(F.col("f")[1], 5).alias("shortest"), _r(F.col("f")[6], 5).alias("longest"))


@query()
def graph_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    f = nb.graph_features(nb.neighbours(p, 8), p, 5)
    return f.select("i", *[_r(F.col("f")[k], 5).alias(f"f{k}") for k in range(18)])


@query()
def quad_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    f = nb.quad_features(nb.neighbours(p, 4), p, (), 4)
    return f.select("i", "n1", "n2", "n3", *[_r(F.col("f")[k], 5).alias(f"f{k}") for k in range(10)])


_HASH = f"""{_REF}, {_knn(5)}, o as (select k.i, k.j, k.rank, k.dist, q.y - p.y as dy, q.x - p.x as dx from knn k join ref p on p.pid = k.i join ref q on q.pid = k.j),
e as (select a.i, a.j, b.j as k, a.rank as jr, b.rank as kr, (b.dy * a.dy + b.dx * a.dx) / a.dist as u, (b.dx * a.dy - b.dy * a.dx) / a.dist as v, a.dist as d from o a join o b on a.i = b.i and b.rank <= 4 and b.j <> a.j where a.rank <= 4 and a.dist > 5 and a.dist < 15),
h as (select i, j, k, jr, kr, floor(sqrt(u * u + v * v) / d / 0.1)::int as rb, floor((case when atan2(v, u) < 0 then atan2(v, u) + 2 * pi() else atan2(v, u) end) / radians(10))::int % 36 as tb from e)"""


@query(f"with {_HASH} select rb, tb, least(count(*), 200) as n from h group by rb, tb")
def hash_build_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    table = hashing.entries_2d(nb.neighbours(p, 5), p, (5.0, 15.0), 4, 4)
    return hashing.capped(table, ["rb", "tb"], 200).groupBy("rb", "tb").agg(F.count(F.lit(1)).alias("n"))


@query()
def hash_probe_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query triples and how many reference entries their bins hold."""
    p, q = reference_points(spark, sf_dir), query_points(spark, sf_dir)
    table = hashing.capped(hashing.entries_2d(nb.neighbours(p, 4), p, (5.0, 15.0), 4, 4), ["rb", "tb"], 200)
    found = hashing.probe_2d(table, hashing.entries_2d(nb.neighbours(q, 4), q, (2.5, 30.0), 4, 4), keep=20)
    return found.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"), _r(F.min("closeness")).alias("closest"))


@query()
def hash_build_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir, ZYX)
    table = hashing.entries_3d(nb.neighbours(p, 4, ZYX), p, (10.0, 80.0), 3, 3, 4)
    return hashing.capped(table, ["ub", "vb", "wb"], 300, ("i", "jr", "kr", "lr")).groupBy("ub", "vb", "wb").agg(F.count(F.lit(1)).alias("n"))


# --- maps ---------------------------------------------------------------------------------------

_C, _S = math.cos(math.radians(TRUTH_2D["angle_deg"])), math.sin(math.radians(TRUTH_2D["angle_deg"]))


@query(f"select count(*) as n, {TRUTH_2D['scale']}::double as scale, {TRUTH_2D['angle_deg']}::double as angle_deg, {TRUTH_2D['t0']}::double as t0, {TRUTH_2D['t1']}::double as t1 from orders")
def fit_similarity_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map between all reference points and their images under the truth's inverse."""
    p = reference_points(spark, sf_dir)
    dy, dx = F.col("y") - TRUTH_2D["t0"], F.col("x") - TRUTH_2D["t1"]
    q = p.select("pid", ((_C * dy + _S * dx) / TRUTH_2D["scale"]).alias("y"), ((-_S * dy + _C * dx) / TRUTH_2D["scale"]).alias("x"))
    fit = reg.fit_pairs_2d(p.select(F.col("pid").alias("i"), F.col("pid").alias("j")), q, p)
    return fit.select("n", _r("scale").alias("scale"), _r(geo.rotation_deg_2d(F.col("r00"), F.col("r10"))).alias("angle_deg"), _r("t0").alias("t0"), _r("t1").alias("t1"))


@query(f"with {_REF} select pid, round(1.25 * ({_C!r} * y - {_S!r} * x) + 18, 6) as y, round(1.25 * ({_S!r} * y + {_C!r} * x) - 12, 6) as x from ref")
def apply_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = geo.apply_similarity_2d("y", "x", F.lit(1.25), F.lit(_C), F.lit(_S), F.lit(18.0), F.lit(-12.0))
    return reference_points(spark, sf_dir).select("pid", _r(y).alias("y"), _r(x).alias("x"))


@query(f"""with {_REF}, {_MOVED}, {_pairs(0.3, left='moved', same=True)}, best as (select i, min(dist) as dist from pairs group by i), n as (select count(*) as n from ref)
select round(count(*) / any_value(n), 6) as frac_inliers, round(avg(dist), 6) as mean_error_um, count(*) as n_inliers, count(*) / any_value(n) >= 0.6 as success from best, n""")
def quality_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reference_points(spark, sf_dir)
    near = sp.nearest_within(_moved(p).withColumnRenamed("pid", "i"), p.withColumnRenamed("pid", "j"), 0.3)
    return reg.quality(near, p.count(), 0.6).select(_r("frac_inliers").alias("frac_inliers"), _r("mean_error_um").alias("mean_error_um"), "n_inliers", "success")


@query(f"with {_REF} select true as scale_ok, true as angle_ok, true as shift_ok, count(*) as n_query from ref where y >= {QUERY_BOX[0]} and y < {QUERY_BOX[1]} and x >= {QUERY_BOX[0]} and x < {QUERY_BOX[1]}")
def icp_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinement from a slightly wrong map ends at the truth."""
    p, q = reference_points(spark, sf_dir), query_points(spark, sf_dir)
    angle = math.radians(TRUTH_2D["angle_deg"] + 0.2)
    start = spark.createDataFrame([(TRUTH_2D["scale"] * 1.002, math.cos(angle), math.sin(angle), TRUTH_2D["t0"] + 0.3, TRUTH_2D["t1"] - 0.3)], ", ".join(f"{c} double" for c in reg.MAP_2D))
    end = reg.refine_2d(start, q, p, 3.0) or dict.fromkeys(reg.MAP_2D, float("nan"))
    turned = math.degrees(math.atan2(end["r10"], end["r00"]))
    checks = {"scale_ok": abs(end["scale"] / TRUTH_2D["scale"] - 1) < 0.01, "angle_ok": abs(turned - TRUTH_2D["angle_deg"]) < 0.5, "shift_ok": abs(end["t0"] - TRUTH_2D["t0"]) < 0.5 and abs(end["t1"] - TRUTH_2D["t1"]) < 0.5}
    return q.agg(F.count(F.lit(1)).alias("n_query")).select(*[F.lit(v).alias(k) for k, v in checks.items()], "n_query")


@query("select p_partkey, (p_size + 1) * (p_size + 2) * 4 as volume_a, 10 * 10 * 10 as volume_b, round(greatest(0, least(p_size + 1, 10)) * greatest(0, least(p_size + 2, 10)) * greatest(0, least(4, 10)) / ((p_size + 1) * (p_size + 2) * 4 + 1000.0 - greatest(0, least(p_size + 1, 10)) * greatest(0, least(p_size + 2, 10)) * 4), 6) as iou from part")
def bbox_iou_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    a = [F.lit(0), n + 1, F.lit(0), n + 2, F.lit(0), F.lit(4)]
    b = [F.lit(v) for v in (0, 10, 0, 10, 0, 10)]
    return read_table(spark, sf_dir, "part").select("p_partkey", geo.box_volume(a).cast("int").alias("volume_a"), geo.box_volume(b).cast("int").alias("volume_b"), _r(geo.box_iou(a, b)).alias("iou"))


@query("""select p_partkey, least(greatest(p_size - 10, 0), 30) as lo, greatest(least(greatest(p_size - 10, 0), 30), least(greatest(p_size + 5, 0), 30)) as hi from part""")
def bbox_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = geo.clamp_range(F.col("p_size") - 10, F.col("p_size") + 5, 30)
    return read_table(spark, sf_dir, "part").select("p_partkey", low.alias("lo"), high.alias("hi"))


@query("select p_partkey, round(1.5 * 0.8 * 2.0 / p_size, 6) as a00, round(-1.5 * 0.6 * 2.0 / p_size, 6) as a01, round(p_retailprice / p_size, 6) as b0 from part")
def affine_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = geo.affine_px_2d(F.lit(1.5), F.lit(0.8), F.lit(0.6), F.col("p_retailprice"), F.lit(0.0), F.lit(2.0), F.col("p_size").cast("double"))
    return read_table(spark, sf_dir, "part").select("p_partkey", *[_r(a[k]).alias(k) for k in ("a00", "a01", "b0")])
