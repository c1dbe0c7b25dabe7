"""Column expressions on half-open boxes ``[lo0, hi0, lo1, hi1, ...]`` in two and three dimensions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.geometry import clamp_range, relative_error

Box = Sequence[Column]


def checked(box: Box) -> list[Column]:
    """The box with whole limits; limits in the wrong order are an error."""
    whole = [F.col(b).cast("int") if isinstance(b, str) else b.cast("int") for b in box]
    out = []
    for low, high in zip(whole[::2], whole[1::2], strict=True):
        fits = high >= low
        out += [F.when(fits, limit).otherwise(F.raise_error(F.lit("a box ends before it starts")).cast("int")) for limit in (low, high)]
    return out


def sides(box: Box) -> list[Column]:
    return [high - low for low, high in zip(box[::2], box[1::2], strict=True)]


def is_empty(box: Box) -> Column:
    return F.least(*sides(box)) <= 0


def grown(box: Box, margin: float | Sequence[float], shape: Sequence[int] | None = None) -> list[Column]:
    """The box with a margin, rounded up, on all sides; cut at the edges of ``shape`` but not widened there."""
    margins = [margin] * (len(box) // 2) if isinstance(margin, (int, float)) else list(margin)
    if len(margins) != len(box) // 2 or not all(math.isfinite(m) and m >= 0 for m in margins):
        raise ValueError("margins are one number, or one for each axis, and not negative")
    out = []
    for k, m in enumerate(margins):
        low, high = box[2 * k] - math.ceil(m), box[2 * k + 1] + math.ceil(m)
        out += [low, high] if shape is None else [F.greatest(F.lit(0), low), F.least(F.lit(int(shape[k])), high)]
    return out


def shape_names(box: Mapping[str, Column]) -> dict[str, Column]:
    """The forms in which boxes are written down: limits by axis, and rows and columns first."""
    y0, y1, x0, x1 = (box[c] for c in ("y0", "y1", "x0", "x1"))
    return {"y0y1x0x1": F.array(y0, y1, x0, x1), "y0x0y1x1": F.array(y0, x0, y1, x1), "yxhw": F.array(y0, x0, y1 - y0, x1 - x0)}


def normalised(limits: Column, named: Column | None = None) -> list[Column]:
    """``[y0, y1, x0, x1]`` from an array of four, or else from a struct with these names; none of both is an error."""
    out = []
    for k, name in enumerate(("y0", "y1", "x0", "x1")):
        listed = F.when(F.size(limits) == 4, F.get(limits, k))
        found = listed if named is None else F.coalesce(listed, named.getField(name))
        out.append(F.coalesce(found.cast("int"), F.raise_error(F.lit("no box of four limits")).cast("int")))
    return out


def mapped(affine: Mapping[str, Column], source: Sequence[int], target: Sequence[int] | None = None, margin: int = 0) -> list[Column]:
    """The box of an image's corners under a pixel map; inside ``target``, if that is given, and one pixel wide at least."""
    height, width = source
    corners = [(y, x) for y in (0, height) for x in (0, width)]
    out = []
    for k in (0, 1):
        places = [affine[f"a{k}0"] * float(y) + affine[f"a{k}1"] * float(x) + affine[f"b{k}"] for y, x in corners]
        low, high = F.floor(F.least(*places)).cast("int") - margin, F.ceil(F.greatest(*places)).cast("int") + margin
        out += [low, high] if target is None else clamp_range(low, high, target[k], 1)
    if target is None:
        blank = is_empty(out)
        out = [F.when(blank, low + 1).otherwise(high) if k else low for low, high in zip(out[::2], out[1::2], strict=True) for k in (0, 1)]
    return out


def differs(a: Box, b: Box, size_tolerance: float = 0.25, centre_tolerance: float = 0.25) -> Column:
    """Whether box a is not about as large as b, or not about where b is; both as shares of b's sides."""
    verdict = F.lit(False)
    for k in range(0, len(a), 2):
        mine, theirs = (F.greatest(F.lit(1), box[k + 1] - box[k]) for box in (a, b))
        moved = F.abs((a[k] + a[k + 1]) - (b[k] + b[k + 1])) / 2
        verdict = verdict | (relative_error(mine, theirs) > size_tolerance) | (moved / theirs > centre_tolerance)
    return verdict


#: Names of the ways to choose a common pixel size.
STRATEGIES = {
    "full": ("match_full", "full", "keep_full", "match_crop_to_full"), "crop": ("match_crop", "crop", "keep_crop", "match_full_to_crop"),
    "largest": ("coarsest", "coarse", "max"), "smallest": ("finest", "fine", "min"), "mean": ("mean", "average", "avg"), "given": ("custom", "user", "manual"),
}


def common_pixel_size(full: Column, crop: Column, strategy: str = "coarsest", given: float | None = None) -> Column:
    """The pixel size that two images are brought to."""
    name = strategy.strip().lower()
    kind = next((k for k, names in STRATEGIES.items() if name in names), None)
    if kind is None or (kind == "given" and not (given and given > 0)):
        raise ValueError(f"unknown strategy {strategy!r}, or no size given")
    chosen = {"full": full, "crop": crop, "largest": F.greatest(full, crop), "smallest": F.least(full, crop), "mean": (full + crop) / 2, "given": F.lit(float(given or 0))}[kind]
    fits = (full > 0) & (crop > 0) & (full < float("inf")) & (crop < float("inf"))
    return F.when(fits, chosen).otherwise(F.raise_error(F.lit("pixel sizes must be positive")).cast("double"))


def resolved_pixel_size(manual: Column, metadata: Column, fallback: float = 1.0) -> dict[str, Column]:
    """``um_per_px`` and where it comes from: a manual value, else the image's, else the fallback."""
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (c > 0) & (c < float("inf"))
    last = fallback if math.isfinite(fallback) and fallback > 0 else 1.0
    return {
        "um_per_px": F.when(good(manual), manual).when(good(metadata), metadata).otherwise(last),
        "source": F.when(good(manual), "manual").when(good(metadata), "metadata").otherwise("fallback"),
    }


def required_voxel_size(metadata: Column, fallback: Column | None = None) -> Column:
    """The size if it is positive, else the fallback; no size is ever made up."""
    positive = F.when((metadata > 0) & (metadata < float("inf")), metadata)
    return F.coalesce(positive, *([] if fallback is None else [fallback]), F.raise_error(F.lit("no voxel size")).cast("double"))


def original_pixels(place: Column, factor: Column | None) -> Column:
    """A place in the image as it was before it was scaled by ``factor`` (none: as it is)."""
    return place if factor is None else place / F.when(factor.isNull() | (factor == 0), 1.0).otherwise(factor)


def morphology(area: Column, perimeter: Column, major: Column, minor: Column, um_per_px: float = 1.0) -> dict[str, Column]:
    """Ratios of a flat object's measures in pixels, and the diameter of the disc of its area in micrometres."""
    tiny = 1e-8
    disc = 4 * math.pi * area / (perimeter * perimeter + tiny)
    return {"aspect_ratio": major / (minor + tiny), "circularity": F.least(F.lit(1.0), disc), "equiv_diameter_um": 2 * um_per_px * F.sqrt(area / math.pi)}


def sphericity(volume: Column, surface: Column) -> Column:
    """Surface of the ball of that volume over the surface, 1 at most."""
    return F.when(surface > 0, F.least(F.lit(1.0), F.pow(F.lit(math.pi), 1 / 3) * F.pow(6 * volume, F.lit(2 / 3)) / surface))


def shape_label(*sizes: Column) -> Column:
    """``ZxYxX`` of sizes."""
    return F.concat_ws("x", *[s.cast("long").cast("string") for s in sizes])


def log_edges(low: float, high: float, bins: int) -> list[int]:
    """Whole edges of up to ``bins`` bins, evenly spaced by logarithm, each larger than the one before."""
    if not 0 < low <= high or bins < 1:
        raise ValueError("edges need 0 < low <= high and a bin")
    steps = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * k / bins) for k in range(bins + 1)]
    rounded = [math.floor(steps[0]), *[math.floor(s + 0.5) for s in steps[1:-1]], math.ceil(steps[-1])]
    out = sorted(set(rounded))
    return out if len(out) > 1 else [out[0], out[0] + 1]
