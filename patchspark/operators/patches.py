"""Windows out of images, and overlapping windows averaged back, by bands of lines.

An image of any height is cut into bands of BAND lines. A band has the lines above its own windows' last line too, so each
pixel is sent to its band and, if need be, to the bands above it; windows are then views of one array. Folding goes the
other way: windows are added up inside their band, and only the lines that two bands share are summed by a grouping.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a band.
BAND = 64


def _key(px: DataFrame) -> str:
    """The type of the images' ids."""
    return px.schema["image_id"].dataType.simpleString()


def _bands(px: DataFrame, p: int, band: int) -> DataFrame:
    """px with the bands whose windows reach its line."""
    first = F.greatest(F.floor((F.col("y") - (p - 1)) / band), F.lit(0))
    return px.select("image_id", F.explode(F.sequence(first, F.floor(F.col("y") / band))).alias("band"), "c", "y", "x", "v")


def _cut(key: tuple, part: pd.DataFrame, p: int, stride: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(py, px, a row of numbers a window) of the windows of a band."""
    c, y, x = (part[k].to_numpy() for k in ("c", "y", "x"))
    top = int(key[1]) * band
    dense = np.zeros((c.max() + 1, y.max() - top + 1, x.max() + 1))
    dense[c, y - top, x] = part["v"].to_numpy()
    if dense.shape[1] < p or dense.shape[2] < p:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, len(dense) * p * p))
    views = np.lib.stride_tricks.sliding_window_view(dense, (p, p), axis=(1, 2))  # c, py, px, dy, dx
    py, at = (np.arange(n) for n in views.shape[1:3])
    py, at = py[((py + top) % stride == 0) & (py < band)], at[at % stride == 0]
    v = views[:, py][:, :, at].transpose(1, 2, 0, 3, 4).reshape(len(py) * len(at), -1)
    return np.repeat(py + top, len(at)), np.tile(at, len(py)), v


def extract_patches(px: DataFrame, p: int, stride: int = 1, band: int = BAND) -> DataFrame:
    """(image_id, py, px, v): all p x p windows whose place is a multiple of stride; v runs over channels, lines, columns.

    An image smaller than the window has none.
    """
    def windows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        py, at, v = _cut(key, part, p, stride, band)
        return pd.DataFrame({"image_id": key[0], "py": py, "px": at, "v": pd.Series(list(v), dtype=object)})

    return _bands(px, p, band).groupBy("image_id", "band").applyInPandas(windows, f"image_id {_key(px)}, py int, px int, v array<double>")


def packed_patches(px: DataFrame, p: int, stride: int = 1, band: int = BAND, rows: int = 512, keys: Callable | None = None) -> DataFrame:
    """(image_id, id, n, data): the windows of extract_patches(), `rows` at a time, with their places: layout's packed blocks.

    keys gives the columns of a window from image_id and arrays py and px; these themselves if None.
    """
    def windows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        py, at, v = _cut(key, part, p, stride, band)
        cuts = [slice(i, i + rows) for i in range(0, len(v), rows)]
        own = keys or (lambda i, a, b: {"image_id": np.full(len(a), i), "py": a, "px": b})
        data = [pickle.dumps((own(key[0], py[c], at[c]), v[c]), 5) for c in cuts]
        return pd.DataFrame({"image_id": key[0], "band": key[1], "part": range(len(cuts)), "n": [len(v[c]) for c in cuts], "data": pd.Series(data, dtype=object)})

    blocks = _bands(px, p, band).groupBy("image_id", "band").applyInPandas(windows, f"image_id {_key(px)}, band long, part long, n long, data binary")
    return blocks.select("image_id", F.xxhash64("image_id", "band", "part").alias("id"), "n", "data")


def masked_patches(patches: DataFrame, mask: DataFrame, p: int) -> DataFrame:
    """The patches that lie wholly where mask (image_id, y, x, ok) is true."""
    ok = mask.select("image_id", F.lit(0).alias("c"), "y", "x", F.col("ok").cast("double").alias("v"))
    whole = extract_patches(ok, p).where(F.forall("v", lambda e: e == 1.0)).select("image_id", "py", "px")
    return patches.join(whole, ["image_id", "py", "px"], "left_semi")


def patch_count(height: Column, width: Column, p: int) -> Column:
    return F.greatest(height - p + 1, F.lit(0)).cast("long") * F.greatest(width - p + 1, F.lit(0)).cast("long")


def check_patchable(scales: DataFrame, p: int, skipped: DataFrame | None = None) -> DataFrame:
    """scales as they are; a denoised scale with a side below p raises an error."""
    checked = scales if skipped is None else scales.join(skipped, ["image_id", "scale"], "left_anti")
    if checked.where(F.least("height", "width") < p).limit(1).count():
        raise ValueError(f"a scale is smaller than the {p} x {p} patch")
    return scales


def gaussian_window(spark, p: int, rho: float = float("inf")) -> DataFrame:
    """(dy, dx, w): separable weights exp(-g*g / (2 rho*rho)) with g from -1 to 1."""
    g = lambda c: F.lit(-1.0) + 2 * F.col(c) / (p - 1) if p > 1 else F.lit(-1.0)
    w = lambda c: F.exp(-0.5 * F.pow(g(c) / rho, F.lit(2.0))) if rho != float("inf") else F.lit(1.0)
    grid = spark.range(p * p).select(F.floor(F.col("id") / p).cast("int").alias("dy"), (F.col("id") % p).cast("int").alias("dx"))
    return grid.withColumn("w", w("dy") * w("dx"))


def window_weights(p: int, rho: float = float("inf")) -> np.ndarray:
    """gaussian_window() as a (p, p) array."""
    g = np.linspace(-1, 1, p) if p > 1 else np.array([-1.0])
    w = np.ones(p) if math.isinf(rho) else np.exp(-0.5 * (g / rho) ** 2)
    return w[:, None] * w[None, :]


def fold(patches: DataFrame, grid: DataFrame, rho: float, p: int, stride: int = 1, band: int = BAND) -> DataFrame:
    """Pixels (image_id, c, y, x, v) of grid: the mean of all patches over them, weighed by their window.

    With a stride above 1 some pixels may have no patch, and are 0.
    """
    weights = window_weights(p, rho)

    def added(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["v"]).reshape(len(part), -1, p, p)
        y, x = part["py"].to_numpy() - int(key[1]) * band, part["px"].to_numpy()
        total = np.zeros((v.shape[1], y.max() + p, x.max() + p))
        under = np.zeros(total.shape[1:])
        for dy in range(p):
            for dx in range(p):  # the places of one offset are all different
                total[:, y + dy, x + dx] += weights[dy, dx] * v[:, :, dy, dx].T
                under[y + dy, x + dx] += weights[dy, dx]
        at_y, at_x = np.nonzero(under)
        n = len(v[0])
        return pd.DataFrame({"image_id": key[0], "c": np.repeat(np.arange(n), len(at_y)), "y": np.tile(at_y + int(key[1]) * band, n),
                             "x": np.tile(at_x, n), "total": total[:, at_y, at_x].ravel(), "under": np.tile(under[at_y, at_x], n)})

    parts = patches.withColumn("band", F.floor(F.col("py") / band)).groupBy("image_id", "band").applyInPandas(
        added, f"image_id {_key(patches)}, c int, y int, x int, total double, under double")
    keys = ["image_id", "c", "y", "x"]
    value = (F.col("total") / F.col("under")).alias("v")
    if p - 1 > band:
        out = parts.groupBy(*keys).agg((F.sum("total") / F.sum("under")).alias("v"))
    else:
        shared = (F.col("y") % band < p - 1) & (F.col("y") >= band)
        seams = parts.where(shared).groupBy(*keys).agg((F.sum("total") / F.sum("under")).alias("v"))
        out = parts.where(~shared).select(*keys, value).unionByName(seams)
    if stride == 1:
        return out
    return grid.select(keys).join(out.hint("merge"), keys, "left").select(*keys, F.coalesce("v", F.lit(0.0)).alias("v"))
