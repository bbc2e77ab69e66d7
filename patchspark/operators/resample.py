"""Separable resampling and pyramids.

A side is resampled in bands across it, each of which is one small matrix product; weights are the same for all images of
the same sides. contributions() gives the weights as a table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchspark.functions.geometry import of_image, sizes

#: Support width of each kernel; the default is the cubic one with wider support.
WIDTHS = {None: 6, "cubic": 4, "lanczos2": 4, "lanczos3": 6, "box": 1, "linear": 2}
#: Added to both sides of a Lanczos quotient: single-precision epsilon.
EPS = 1.1920929e-7
#: Lines or columns of a band.
BAND = 64


def kernel(name: str | None, d: Column) -> Column:
    a = F.abs(d)
    if name in (None, "cubic"):
        near = 1.5 * a * a * a - 2.5 * a * a + 1
        return F.when(a <= 1, near).when(a <= 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)
    if name == "linear":
        return F.greatest(1 - a, F.lit(0.0))
    if name == "box":
        return F.when((d >= -0.5) & (d < 0.5), 1.0).otherwise(0.0)
    lobes = int(name[-1])
    top = F.sin(math.pi * d) * F.sin(math.pi * d / lobes) + EPS
    return F.when(a < lobes, top / (math.pi**2 * d * d / lobes + EPS)).otherwise(0.0)


def contributions(shapes: DataFrame, name: str | None = None, antialias: bool = True) -> DataFrame:
    """(keys, out_idx, in_idx, w) of shapes (keys, n_in, n_out): which source places make each place, weights summing to 1.

    Sources beyond the border are mirrored, the border place itself counted twice.
    """
    keys = [c for c in shapes.columns if c not in ("n_in", "n_out")]
    s = shapes.withColumn("s", F.col("n_out") / F.col("n_in"))
    s = s.withColumn("k", F.when(F.lit(antialias) & (F.col("s") < 1), F.col("s")).otherwise(1.0)).withColumn("width", WIDTHS[name] / F.col("k"))
    s = s.withColumn("o", F.explode(F.sequence(F.lit(1), F.col("n_out").cast("int"))))
    m = (F.col("o") - (F.col("n_out") - F.col("n_in") * F.col("s")) / 2) / F.col("s") + 0.5 * (1 - 1 / F.col("s"))
    s = s.withColumn("m", m).withColumn("left", F.floor(F.col("m") - F.col("width") / 2))
    s = s.withColumn("j", F.explode(F.sequence(F.col("left") - 1, F.col("left") + F.ceil("width"))))
    w = F.col("k") * kernel(name, F.col("k") * (F.col("m") - F.col("j") - 1))
    at = F.pmod(F.col("j"), 2 * F.col("n_in"))
    at = F.when(at < F.col("n_in"), at).otherwise(2 * F.col("n_in") - 1 - at).cast("int")
    s = s.select(*keys, (F.col("o") - 1).alias("out_idx"), at.alias("in_idx"), w.alias("w")).groupBy(*keys, "out_idx", "in_idx").agg(F.sum("w").alias("w"))
    total = s.groupBy(*keys, "out_idx").agg(F.sum("w").alias("total"))
    return s.where("w <> 0").join(total, [*keys, "out_idx"]).select(*keys, "out_idx", "in_idx", (F.col("w") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("w"))


def _kernel(name: str | None, d: np.ndarray) -> np.ndarray:
    """kernel() of an array."""
    a = np.abs(d)
    if name in (None, "cubic"):
        return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a <= 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0.0))
    if name == "linear":
        return np.maximum(1 - a, 0.0)
    if name == "box":
        return ((d >= -0.5) & (d < 0.5)).astype(float)
    lobes = int(name[-1])
    return np.where(a < lobes, (np.sin(math.pi * d) * np.sin(math.pi * d / lobes) + EPS) / (math.pi**2 * d * d / lobes + EPS), 0.0)


@lru_cache(64)
def taps(n_in: int, n_out: int, name: str | None = None, antialias: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(source places, weights), one line of taps for each place made: contributions() of one side as arrays."""
    s = n_out / n_in
    k = s if antialias and s < 1 else 1.0
    width = WIDTHS[name] / k
    o = np.arange(1, n_out + 1)
    m = (o - (n_out - n_in * s) / 2) / s + 0.5 * (1 - 1 / s)
    j = np.floor(m - width / 2)[:, None] - 1 + np.arange(math.ceil(width) + 2)[None, :]
    w = k * _kernel(name, k * (m[:, None] - j - 1))
    total = w.sum(1, keepdims=True)
    at = j.astype(int) % (2 * n_in)
    return np.where(at < n_in, at, 2 * n_in - 1 - at), w / np.where(total == 0, 1.0, total)


def _along(at: str, other: str, name: str | None, antialias: bool):
    """Resamples a band across the side `at`: groups by (image_id, band, sides before and after)."""
    def made(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        c, here, across = (part[k].to_numpy() for k in ("c", at, other))
        first = across.min()
        dense = np.zeros((c.max() + 1, int(key[2]), across.max() - first + 1))
        dense[c, here, across - first] = part["v"].to_numpy()
        places, weights = taps(int(key[2]), int(key[3]), name, antialias)
        out = sum(weights[:, i, None] * dense[:, places[:, i], :] for i in range(weights.shape[1]))
        c, here, across = (i.ravel() for i in np.indices(out.shape))
        return pd.DataFrame({"image_id": key[0], "c": c, at: here, other: across + first, "v": out.ravel()})[["image_id", "c", "y", "x", "v"]]

    return made


def resize(px: DataFrame, to: DataFrame, name: str | None = None, antialias: bool = True, band: int = BAND) -> DataFrame:
    """Pixels resampled to the (image_id, height, width) of `to`; a side that stays as it is isn't touched.

    Lines first, then columns: a band of columns, or of lines, is one group, so no image is whole in one task.
    """
    own = sizes(px).withColumnsRenamed({"height": "h_in", "width": "w_in"}).join(to.select("image_id", "height", "width"), "image_id")
    keys, schema = ["image_id", "c", "y", "x"], f"image_id {px.schema['image_id'].dataType.simpleString()}, c int, y int, x int, v double"
    out = px.select(*keys, "v")
    for at, other, n_in, n_out in (("y", "x", "h_in", "height"), ("x", "y", "w_in", "width")):
        sized = of_image(out, own.select("image_id", n_in, n_out))
        same = sized.where(F.col(n_in) == F.col(n_out)).select(*keys, "v")
        changed = sized.where(F.col(n_in) != F.col(n_out)).withColumn("band", F.floor(F.col(other) / band))
        out = same.unionByName(changed.groupBy("image_id", "band", n_in, n_out).applyInPandas(_along(at, other, name, antialias), schema))
    return out


def resize_by(px: DataFrame, factor: float, name: str | None = None, antialias: bool = True) -> DataFrame:
    """Pixels resampled by a factor; sides are rounded up."""
    side = lambda c: F.ceil(F.col(c) * factor).cast("int").alias(c)
    return resize(px, sizes(px).select("image_id", side("height"), side("width")), name, antialias)


def short_side_sizes(catalog: DataFrame, side: int) -> DataFrame:
    """(image_id, height, width) of images brought to the short side; proportions stay, halves go to the even number."""
    s = F.lit(float(side)) / F.least("height", "width")
    return catalog.select("image_id", *(F.bround(F.col(c) * s).cast("int").alias(c) for c in ("height", "width")))


def resize_to_short_side(px: DataFrame, side: int) -> DataFrame:
    """Pixels brought to the short side by the antialiased cubic kernel; images that have it stay as they are."""
    return _resized_if(px, short_side_sizes(sizes(px), side))


def preview_sizes(catalog: DataFrame, long_side: int | None) -> DataFrame:
    """Sizes shrunk, never enlarged, to the long side; None leaves all as they are."""
    if long_side is None:
        return catalog.select("image_id", "height", "width")
    most = F.greatest("height", "width")
    s = F.when(most > long_side, F.lit(float(long_side)) / most).otherwise(1.0)
    return catalog.select("image_id", *(F.greatest(F.bround(F.col(c) * s), F.lit(1)).cast("int").alias(c) for c in ("height", "width")))


def preview(px: DataFrame, long_side: int | None) -> DataFrame:
    """Pixels of previews; None gives the pixels as they are."""
    return px if long_side is None else _resized_if(px, preview_sizes(sizes(px), long_side))


def _resized_if(px: DataFrame, to: DataFrame) -> DataFrame:
    other = to.withColumnsRenamed({"height": "h_out", "width": "w_out"}).join(sizes(px), "image_id").where("h_out <> height or w_out <> width")
    other = other.select("image_id", F.col("h_out").alias("height"), F.col("w_out").alias("width"))
    same = px.join(other.select("image_id"), "image_id", "left_anti").select("image_id", "c", "y", "x", "v")
    return same.unionByName(resize(px, other, "cubic"))


def scale_side(c: str, num_scales: Column, least: int | None = None, prefix: str = "", r: float = 0.5) -> Column:
    """The side c at the row's scale; see pyramid_shapes(). prefix: of the columns with the base sizes."""
    height, width, own = F.col(f"{prefix}height"), F.col(f"{prefix}width"), F.col(prefix + c)
    side = lambda of, up=0: F.ceil(of * F.pow(F.lit(r), F.col("scale") - up)).cast("int")
    if least is None:
        return side(own)
    last = (F.col("scale") == num_scales - 1) & (num_scales > 1)
    over = F.least(side(height, 1), side(width, 1))
    bad = F.raise_error(F.concat(F.lit(f"too many scales for a short side of {least}: "), num_scales.cast("string"))).cast("int")
    raised = F.least(F.ceil(own * F.lit(least) / F.least(height, width)), side(own, 1)).cast("int")
    return F.when(last & (over < least), bad).when(last & (F.least(side(height), side(width)) < least), raised).otherwise(side(own))


def pyramid_shapes(catalog: DataFrame, num_scales: int, r: float = 0.5, least: int | None = None) -> DataFrame:
    """(image_id, scale, height, width) from the base sizes; 0 is the finest.

    least: the short side that the coarsest scale of several is raised to, but never above the scale over it; an error
    if that one is below it already.
    """
    scales = catalog.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(num_scales - 1))))
    return scales.select("image_id", "scale", *(scale_side(c, F.lit(num_scales), least, r=r).alias(c) for c in ("height", "width")))


def gaussian_pyramid(px: DataFrame, scales: DataFrame, num_scales: int) -> DataFrame:
    """Pixels of all scales, each resampled from the one above; scales are those of pyramid_shapes()."""
    out = now = px.withColumn("scale", F.lit(0))
    for i in range(1, num_scales):
        now = resize(now.drop("scale"), scales.where(F.col("scale") == i)).withColumn("scale", F.lit(i))
        out = out.unionByName(now)
    return out


def enlarged(coarser: DataFrame, fine: DataFrame) -> DataFrame:
    """coarser at the sizes of fine."""
    return resize(coarser, sizes(fine))


def blend_two_scale(fine: DataFrame, coarser: DataFrame, r: float = 0.5, least: int | None = None, up: DataFrame | None = None) -> DataFrame:
    """up(coarser) + fine - up(down(fine)), down to the second scale of a pyramid of two.

    up: enlarged(coarser, fine), where it is there already (it stays the same within a scale).
    """
    full = sizes(fine)
    small = pyramid_shapes(full, 2, r, least).where("scale = 1").drop("scale")
    low = resize(resize(fine, small), full).withColumn("v", -F.col("v"))
    keys = ["image_id", "c", "y", "x"]
    up = resize(coarser, full) if up is None else up
    return up.unionByName(fine.select(*keys, "v")).unionByName(low).groupBy(*keys).agg(F.sum("v").alias("v"))
