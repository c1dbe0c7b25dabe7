"""Images and label masks as pixel tables ``(..., y, x, val)``: measures, thresholds, warps, stitching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators.components import connected_components
from starloom.session import checkpointed


def label_measures(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, label, area, cy, cx, y0, y1, x0, x1, major, minor, eccentricity, extent``: of each label above 0, box half-open."""
    sums = pixels.filter("label > 0").groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        (F.var_pop("y") + 1 / 12).alias("_yy"), (F.var_pop("x") + 1 / 12).alias("_xx"), F.covar_pop("y", "x").alias("_yx"),
    )
    sums = sums.withColumns({"_h": (F.col("_yy") + F.col("_xx")) / 2, "_r": F.sqrt((F.col("_yy") - F.col("_xx")) * (F.col("_yy") - F.col("_xx")) / 4 + F.col("_yx") * F.col("_yx"))})
    big, small = F.col("_h") + F.col("_r"), F.greatest(F.col("_h") - F.col("_r"), F.lit(0.0))
    return sums.select(
        *by, "label", "area", "cy", "cx", "y0", "y1", "x0", "x1", (4 * F.sqrt(big)).alias("major"), (4 * F.sqrt(small)).alias("minor"), F.sqrt(1 - small / big).alias("eccentricity"),
        (F.col("area") / ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))).alias("extent"),
    )


def voxel_measures(voxels: DataFrame, voxel_um: tuple[float, float, float]) -> DataFrame:
    """``label, voxels, volume_um3, cz, cy, cx, surface_um2``; the surface counts exposed faces, which overestimates smooth ones."""
    dz, dy, dx = voxel_um
    held = voxels.filter("label > 0")
    faces = {"z": dy * dx, "y": dz * dx, "x": dz * dy}
    shared = None
    for axis, face in faces.items():
        w = Window.partitionBy("label", *[a for a in faces if a != axis]).orderBy(axis)
        touching = held.select("label", F.when(F.lag(axis).over(w) == F.col(axis) - 1, 2 * face).otherwise(0.0).alias("inner"))
        shared = touching if shared is None else shared.unionByName(touching)
    inner = shared.groupBy("label").agg(F.sum("inner").alias("inner"))
    sizes = held.groupBy("label").agg(F.count(F.lit(1)).alias("voxels"), *[F.avg(a).alias(f"c{a}") for a in "zyx"])
    total = F.col("voxels") * 2 * sum(faces.values()) - F.col("inner")
    return sizes.join(inner, "label").select("label", "voxels", (F.col("voxels") * dz * dy * dx).alias("volume_um3"), "cz", "cy", "cx", total.alias("surface_um2"))


def percentile_normalised(pixels: DataFrame, low: float = 2.0, high: float = 98.0, by: Sequence[str] = ()) -> DataFrame:
    """Values mapped so that the two percentiles become 0 and 1, clipped."""
    bounds = pixels.groupBy(*by).agg(F.percentile("val", low / 100).alias("_lo"), F.percentile("val", high / 100).alias("_hi"))
    joined = pixels.join(bounds, list(by)) if by else pixels.crossJoin(F.broadcast(bounds))  # one row
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return joined.withColumn("val", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("val") - F.col("_lo")) / span)), F.lit(0.0))).drop("_lo", "_hi")


def otsu_threshold(pixels: DataFrame, bins: int = 256) -> float | None:
    """The bin centre that separates two classes best, from a histogram of fixed size."""
    ends = pixels.agg(F.min("val").alias("a"), F.max("val").alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return ends["a"]
    width = (ends["b"] - ends["a"]) / bins
    bin_no = F.least(F.floor((F.col("val") - ends["a"]) / width), F.lit(bins - 1)).cast("int")
    count = np.zeros(bins)
    for r in pixels.groupBy(bin_no.alias("k")).count().collect():  # a row a bin
        count[r["k"]] = r["count"]
    centre = ends["a"] + (np.arange(bins) + 0.5) * width
    w1, w2 = np.cumsum(count), np.cumsum(count[::-1])[::-1]
    m1 = np.cumsum(count * centre) / np.maximum(w1, 1)
    m2 = (np.cumsum((count * centre)[::-1]) / np.maximum(np.cumsum(count[::-1]), 1))[::-1]
    return float(centre[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)])


def label_components(mask: DataFrame, dims: Sequence[str] = ("y", "x"), min_size: int = 1) -> DataFrame:
    """Connected pixels (sharing an edge or face) get one label: ``*dims, label``, numbered by first pixel key; small ones go.

    mask: the foreground's coordinates, each from 0 to 2^20 - 2; others are an error, as their keys would be those of other pixels.
    """
    key = F.lit(0).cast("long")
    for d in dims:
        fits = F.col(d).between(0, (1 << 20) - 2)
        key = key * (1 << 20) + F.when(fits, F.col(d)).otherwise(F.raise_error(F.lit(f"{d} is out of bounds")).cast("long"))
    nodes = mask.select(*dims, key.alias("a"))
    edges = None
    for d in dims:
        step = 1 << 20 * (len(dims) - 1 - list(dims).index(d))
        pairs = nodes.select("a", (F.col("a") + step).alias("b")).join(nodes.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
        edges = pairs if edges is None else edges.unionByName(pairs)
    found = connected_components(edges).withColumnRenamed("node", "a")
    named = nodes.join(found, "a", "left").select(*dims, F.coalesce("component", "a").alias("label"))
    big = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return named.join(big.select("label"), "label", "left_semi")


def max_projection(voxels: DataFrame, keep: Sequence[str] = ("y", "x"), step: int = 1) -> DataFrame:
    """Largest value over the other axes; every ``step``-th pixel."""
    rows = voxels
    for d in keep:
        rows = rows.filter(F.pmod(F.col(d), F.lit(step)) == 0)
    return rows.groupBy(*keep).agg(F.max("val").alias("val"))


def rescale_factor(px: Column, target: Column, low: float = 0.25, high: float = 4.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), px / target))


def rescaled_labels(pixels: DataFrame, factor: float, height: int, width: int) -> DataFrame:
    """Nearest-neighbour rescale of a label mask to round(size * factor): each target pixel takes the pixel under its centre."""
    spark = pixels.sparkSession
    h, w = max(round(height * factor), 1), max(round(width * factor), 1)
    grid = spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("ty"), (F.col("id") % w).cast("int").alias("tx"))
    under = lambda t, n, m: F.least(F.floor((F.col(t) + 0.5) * n / m).cast("int"), F.lit(n - 1))
    return grid.select("ty", "tx", under("ty", height, h).alias("y"), under("tx", width, w).alias("x")).join(pixels, ["y", "x"]).select(F.col("ty").alias("y"), F.col("tx").alias("x"), "label")


def warped(pixels: DataFrame, inverse: dict[str, Column | float], height: int, width: int, order: int = 1, outside: float = 0.0) -> DataFrame:
    """``y, x, val`` on a target grid: each pixel is looked up at its inverse image, by the nearest or four weighted pixels."""
    spark: SparkSession = pixels.sparkSession
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    a = {k: lit(v) for k, v in inverse.items()}
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    at = grid.select("y", "x", (a["a00"] * F.col("y") + a["a01"] * F.col("x") + a["b0"]).alias("sy"), (a["a10"] * F.col("y") + a["a11"] * F.col("x") + a["b1"]).alias("sx"))
    if order == 0:
        spots = at.select("y", "x", F.rint("sy").cast("int").alias("py"), F.rint("sx").cast("int").alias("px"), F.lit(1.0).alias("w"))
    else:
        corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        near = at.select("*", F.floor("sy").cast("int").alias("fy"), F.floor("sx").cast("int").alias("fx"), corner.alias("c"))
        part = lambda s, f, o: F.when(o == 1, F.col(s) - F.col(f)).otherwise(1 - (F.col(s) - F.col(f)))
        spots = near.select("y", "x", (F.col("fy") + F.col("c.i")).alias("py"), (F.col("fx") + F.col("c.j")).alias("px"), (part("sy", "fy", F.col("c.i")) * part("sx", "fx", F.col("c.j"))).alias("w"))
    source = pixels.select(F.col("y").alias("py"), F.col("x").alias("px"), "val")
    hit = spots.join(source, ["py", "px"], "left").groupBy("y", "x").agg(F.sum(F.col("w") * F.coalesce("val", F.lit(float(outside)))).alias("val"))
    return hit


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``n``, the row's place from 0 in an order: its place in a sorted partition, after the sizes of those before."""
    sorted_ = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(sorted_.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("size"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    return placed.join(F.broadcast(shifts), "_part").withColumn("n", F.col("_at") + F.col("shift")).drop("_part", "_at", "shift")


def stitch_slices(slices: DataFrame, min_iou: float = 0.25) -> DataFrame:
    """``z, y, x, label``: labels of consecutive slices joined where they overlap enough.

    A label inherits the id of the label below that it overlaps most (of equal ones the smaller), if
    their intersection over union reaches the limit; else its id is new. Inheritance
    is a chain of such links, so ids are components of the links.
    """
    held = slices.filter("label > 0").select("z", "y", "x", F.col("label").cast("long").alias("label"))
    area = held.groupBy("z", "label").agg(F.count(F.lit(1)).alias("area"))
    below = held.select((F.col("z") + 1).alias("z"), "y", "x", F.col("label").alias("prev"))
    overlap = held.join(below, ["z", "y", "x"]).groupBy("z", "label", "prev").agg(F.count(F.lit(1)).alias("n"))
    best = overlap.groupBy("z", "label").agg(F.max(F.struct("n", (-F.col("prev")).alias("p"))).alias("m")).select("z", "label", F.col("m.n").alias("n"), (-F.col("m.p")).alias("prev"))
    sized = best.join(area, ["z", "label"]).join(area.select((F.col("z") + 1).alias("z"), F.col("label").alias("prev"), F.col("area").alias("prev_area")), ["z", "prev"])
    node = lambda z, label: F.col(z).cast("long") * (1 << 32) + F.col(label)
    links = sized.filter(F.col("n") / (F.col("area") + F.col("prev_area") - F.col("n")) >= min_iou).select(node("z", "label").alias("a"), ((F.col("z").cast("long") - 1) * (1 << 32) + F.col("prev")).alias("b"))
    found = connected_components(checkpointed(links)).withColumnRenamed("node", "a")
    every = area.select("z", "label", node("z", "label").alias("a")).join(found, "a", "left").select("z", "label", F.coalesce("component", "a").alias("root"))
    names = every.select("root").distinct()
    roots = names.join(area.select(node("z", "label").alias("root"), "label", "z"), "root")
    top = area.filter(F.col("z") == 0).agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
    fresh = _in_order(roots.filter("z > 0").select("root"), "root").crossJoin(F.broadcast(top)).select("root", (F.col("top") + F.col("n") + 1).alias("id"))
    ids = roots.filter("z = 0").select("root", F.col("label").alias("id")).unionByName(fresh)
    return held.join(every.join(ids, "root").select("z", "label", "id"), ["z", "label"]).select("z", "y", "x", F.col("id").alias("label"))


def structural_similarity(a: DataFrame, b: DataFrame, window: int = 7, span: float = 1.0) -> DataFrame:
    """One row ``ssim``: mean over all full windows, from box sums along rows and columns."""
    half = window // 2
    both = a.select("y", "x", F.col("val").alias("a")).join(b.select("y", "x", F.col("val").alias("b")), ["y", "x"])
    terms = both.select("y", "x", "a", "b", (F.col("a") * F.col("a")).alias("aa"), (F.col("b") * F.col("b")).alias("bb"), (F.col("a") * F.col("b")).alias("ab"))
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(other).orderBy(axis).rowsBetween(-half, half)
        terms = terms.select("y", "x", *[F.avg(c).over(w).alias(c) for c in ("a", "b", "aa", "bb", "ab")], F.count(F.lit(1)).over(w).alias("_n")).filter(F.col("_n") == window).drop("_n")
    unbias = window * window / (window * window - 1)
    va, vb, vab = (unbias * (F.col(p) - F.col(q) * F.col(r)) for p, q, r in (("aa", "a", "a"), ("bb", "b", "b"), ("ab", "a", "b")))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    value = (2 * F.col("a") * F.col("b") + c1) * (2 * vab + c2) / ((F.col("a") * F.col("a") + F.col("b") * F.col("b") + c1) * (va + vb + c2))
    return terms.agg(F.avg(value).alias("ssim"))


def as_uint16(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Values stretched from their least and largest to 0..65535 and cut to whole numbers; all 0 where these don't differ."""
    number = F.when(~F.isnan(value), F.col(value))
    ends = pixels.agg(F.min(number).alias("_low"), F.max(number).alias("_high"))  # one row
    share = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return pixels.crossJoin(F.broadcast(ends)).withColumn(value, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 65535).cast("int")).drop("_low", "_high")
