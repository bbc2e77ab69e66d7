"""Quality measures, guidance and embedding aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchspark.functions.geometry import of_image, with_size
from patchspark.operators.selection import order_statistic


def mirror_asymmetry(px: DataFrame, axis: str = "horizontal") -> DataFrame:
    """(image_id, asymmetry): mean |v - mirrored v| in grey levels; 0 for a symmetric image. horizontal compares left and right."""
    if axis not in ("horizontal", "vertical"):
        raise ValueError(f"no axis: {axis}")
    at, side = ("x", "width") if axis == "horizontal" else ("y", "height")
    low = F.least(F.col(at), F.col(side) - 1 - F.col(at))
    other = "y" if at == "x" else "x"
    pairs = with_size(px).groupBy("image_id", "c", other, low.alias("low")).agg((F.max("v") - F.min("v")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("image_id").agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n") * 127.5).alias("asymmetry"))


def seam_error(px: DataFrame, direction: str = "horizontal") -> DataFrame:
    """(image_id, seam): how far the mean gap across the wrap exceeds the lower median of the gaps inside, in grey levels.

    horizontal looks across the left and right ends, vertical across top and bottom, both takes the larger.
    """
    if direction == "both":
        two = seam_error(px, "horizontal").unionByName(seam_error(px, "vertical"))
        return two.groupBy("image_id").agg(F.max("seam").alias("seam"))
    if direction not in ("horizontal", "vertical"):
        raise ValueError(f"no direction: {direction}")
    at, side, other = ("x", "width", "y") if direction == "horizontal" else ("y", "height", "x")
    line = Window.partitionBy("image_id", "c", other).orderBy(at)
    gaps = with_size(px).select("image_id", F.abs(F.col("v") - F.lag("v").over(line)).alias("inside"),
                                F.when(F.col(at) == F.col(side) - 1, F.abs(F.col("v") - F.first("v").over(line))).alias("wrap"))
    wraps = gaps.groupBy("image_id").agg(F.avg("wrap").alias("wrap"))
    middle = order_statistic(gaps, ["image_id"], "inside", F.ceil(F.col("n") / 2) - 1)
    excess = F.col("wrap") - F.coalesce("inside", F.lit(0.0))
    return wraps.join(middle, "image_id", "left").select("image_id", (F.greatest(F.lit(0.0), excess) * 127.5).alias("seam"))


def grad_energy(grad: DataFrame) -> DataFrame:
    """(image_id, y, x, energy): the norm of the gradient over the channels."""
    return grad.groupBy("image_id", "y", "x").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("energy"))


def thresholded_grad(grad: DataFrame, quantile: float = 0.8) -> DataFrame:
    """(image_id, c, y, x, v, mask): the gradient shrunk by its image's nearest-rank quantile of energy.

    mask: whether the energy at the place is above the quantile; elsewhere v is 0.
    """
    energy = grad_energy(grad)
    q = order_statistic(energy, ["image_id"], "energy", F.bround((F.col("n") - 1) * quantile)).withColumnRenamed("energy", "q")
    out = grad.join(energy.hint("merge"), ["image_id", "y", "x"])
    out = of_image(out, q).withColumn("mask", F.col("energy") > F.col("q"))
    shrunk = (F.col("energy") - F.col("q")) * F.col("v") / F.nullif(F.col("energy"), F.lit(0.0))
    return out.select("image_id", "c", "y", "x", F.when(F.col("mask"), shrunk).otherwise(0.0).alias("v"), "mask")


#: The sentences that a description is put into, for sharp and for coarse images.
TEMPLATES = {
    "hr": ["photo of {}.", "high quality photo of {}.", "a photo of {}.", "the photo of {}.", "image of {}.", "an image of {}.",
           "high quality image of {}.", "a high quality image of {}.", "the {}.", "a {}.", "{}.", "{}", "{}!", "{}..."],
    "lr": ["photo of {}.", "low quality photo of {}.", "low resolution photo of {}.", "low-res photo of {}.", "blurry photo of {}.",
           "pixelated photo of {}.", "a photo of {}.", "the photo of {}.", "image of {}.", "an image of {}.", "low quality image of {}.",
           "a low quality image of {}.", "low resolution image of {}.", "a low resolution image of {}.", "low-res image of {}.",
           "a low-res image of {}.", "blurry image of {}.", "a blurry image of {}.", "pixelated image of {}.", "a pixelated image of {}.",
           "the {}.", "a {}.", "{}.", "{}", "{}!", "{}..."],
}


def templates(flag: str) -> list[str]:
    if flag not in TEMPLATES:
        raise ValueError(f"no set of templates: {flag}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[flag]


def compose_prompts(texts: DataFrame, templates: list[str]) -> DataFrame:
    """Every text in every template, in place of {}."""
    return texts.withColumn("template", F.explode(F.array(*map(F.lit, templates)))).select(
        "text", F.replace("template", F.lit("{}"), "text").alias("prompt"))


def average_embeddings(vectors: DataFrame, by: str) -> DataFrame:
    """(by, i, mean) by element."""
    return vectors.select(by, F.posexplode("v").alias("i", "e")).groupBy(by, "i").agg(F.avg("e").alias("mean"))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def cosine_loss(pairs: DataFrame, by: str, scaling: float = 1.2) -> DataFrame:
    """(by, loss) of pairs (by, x, y): scaling * (1 - mean cosine)."""
    return pairs.groupBy(by).agg((scaling * (1 - F.avg(cosine(F.col("x"), F.col("y"))))).alias("loss"))
