"""Per-pixel column work: ranges, crops, mirrors, rolls, tiles and masks of shifted views."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFTS = {"no": (0, 0), "horiz": (0, 1), "vert": (1, 0), "diag": (1, 1)}


def normalize(v: Column) -> Column:
    return v * 2 - 1


def unnormalize(v: Column) -> Column:
    return (v + 1) * 0.5


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def with_size(px: DataFrame) -> DataFrame:
    return of_image(px, sizes(px))


def of_image(px: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """px with the columns of its image's row in `rows`, which are told to be the side that is broadcast: Spark would take
    flat pixels, whose files are small, and gather them all in the driver."""
    return px.join(F.broadcast(rows), "image_id", how)


def half(c: str) -> Column:
    return F.floor(F.col(c) / 2).cast("int")


def crop_to_multiple(px: DataFrame, m: int = 16) -> DataFrame:
    """The centre of each image, with sides cut down to multiples of m."""
    s = with_size(px)
    for side, at in (("height", "y"), ("width", "x")):
        kept = F.col(side) - F.col(side) % m
        first = F.floor((F.col(side) - kept) / 2).cast("int")
        s = s.where((F.col(at) >= first) & (F.col(at) < first + kept)).withColumn(at, F.col(at) - first)
    return s.select(px.columns)


def latent_side(side: Column, m: int = 16, f: int = 8) -> Column:
    return F.floor(F.floor(side / m) * m / f).cast("int")


def requested_size(request: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """The sides in a text like (H, W); null means the image's own; other texts raise an error."""
    pattern = r"^\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*$"
    bad = F.raise_error(F.concat(F.lit("not a size: "), request)).cast("int")
    return tuple(F.when(request.isNull(), own).when(request.rlike(pattern), F.regexp_extract(request, pattern, i).cast("int")).otherwise(bad)
                 for i, own in ((1, height), (2, width)))


def sample_sizes(catalog: DataFrame, latent: bool = False) -> DataFrame:
    """catalog (image_id, height, width, request) with sample_height and sample_width: the size asked for, or the own one.

    latent: sizes are in cells of the encoder, which takes sides down to a multiple first.
    """
    sides = requested_size(F.col("request"), F.col("height"), F.col("width"))
    return catalog.select("*", *((latent_side(c) if latent else c).alias(f"sample_{name}") for c, name in zip(sides, ("height", "width"), strict=True)))


def symmetrize(px: DataFrame, axis: str = "horizontal", source: str | None = None) -> DataFrame:
    """One half of each image mirrored onto the other; an odd side keeps its middle line.

    horizontal mirrors along the lines, left to right or back; vertical along the columns, top to bottom or back.
    """
    if axis not in ("vertical", "horizontal"):
        raise ValueError(f"no axis: {axis}")
    legal = ("left", "right") if axis == "horizontal" else ("top", "bottom")
    if source not in legal:
        if source is not None:
            warnings.warn(f"{source} is no side of the {axis} axis; {legal[0]} is taken", stacklevel=2)
        source = legal[0]
    at, side = ("x", "width") if axis == "horizontal" else ("y", "height")
    here, mirror = F.col(at), F.col(side) - 1 - F.col(at)
    kept = here <= mirror if source in ("left", "top") else here >= mirror
    return with_size(px).where(kept).withColumn(at, F.explode(F.array_distinct(F.array(here, mirror)))).select(px.columns)


def roll(px: DataFrame, shift: str, back: bool = False) -> DataFrame:
    """A circular shift by half the sides named in SHIFTS, or back again."""
    dy, dx = SHIFTS[shift]
    sign = -1 if back else 1
    moved = with_size(px).withColumn("y", F.pmod(F.col("y") + sign * dy * half("height"), F.col("height"))).withColumn(
        "x", F.pmod(F.col("x") + sign * dx * half("width"), F.col("width")))
    return moved.select(px.columns)


def tile_grid(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each image repeated rows x cols times."""
    t = with_size(px).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return t.withColumn("y", F.col("y") + F.col("r") * F.col("height")).withColumn("x", F.col("x") + F.col("k") * F.col("width")).select(px.columns)


#: The grids (rows, columns) that show whether an image is seamless in a direction.
GRIDS = {"horizontal": [(1, 2), (1, 3)], "vertical": [(2, 1), (3, 1)], "both": [(2, 2), (3, 3)]}


def tile_grids(px: DataFrame, direction: str) -> DataFrame:
    """(image_id, rows, cols, c, y, x, v): each image in the two grids of the direction."""
    if direction not in GRIDS:
        raise ValueError(f"no direction: {direction}")
    out = None
    for rows, cols in GRIDS[direction]:
        grid = tile_grid(px, rows, cols).select("image_id", F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), "c", "y", "x", "v")
        out = grid if out is None else out.unionByName(grid)
    return out


def shift_weight(direction: str, shift: str, num_shifts: int = 4) -> Column:
    """The weight at (y, x) of a view shifted by half, in an image of (height, width)."""
    def middle(at: str, side: str) -> Column:
        return (F.col(at) >= F.floor(F.col(side) / 4)) & (F.col(at) < F.floor(F.col(side) * 3 / 4))

    rows, cols = middle("y", "height"), middle("x", "width")
    if direction == "horizontal":
        w = {"no": cols, "horiz": ~cols}
    elif direction == "vertical":
        w = {"no": rows, "vert": ~rows}
    elif direction != "both":
        raise ValueError(f"no direction: {direction}")
    elif num_shifts == 4:
        w = {"no": rows & cols, "horiz": rows & ~cols, "vert": ~rows & cols, "diag": ~rows & ~cols}
    else:
        w = {"no": rows & cols, "horiz": ~cols, "vert": ~rows}
    return w.get(shift, F.lit(False)).cast("double")


def blend_shifts(views: DataFrame) -> DataFrame:
    """Weighted mean by pixel of (image_id, c, y, x, v, w)."""
    return views.groupBy("image_id", "c", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
