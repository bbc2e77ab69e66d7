"""Planning for a catalogue of images: depth, backend, stride and chunks by scale; and rollups of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchspark.operators.patches import patch_count
from patchspark.operators.resample import scale_side
from patchspark.operators.selection import running_sums


def auto_num_scales(short: Column, min_short: Column) -> Column:
    """The smallest n with min_short * 2^(n-1) >= short; an error if min_short is above short."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(40)), lambda n: min_short * F.pow(F.lit(2.0), n - 1) >= short)
    return F.when(min_short > short, F.raise_error(F.lit("the coarsest side is above the image's")).cast("int")).otherwise(F.array_min(fits))


def auto_backend(count: Column, threshold: int = 250_000) -> Column:
    return F.when(count > threshold, "ann").otherwise("exact")


def auto_query_stride(count: Column, threshold: int = 8_000_000) -> Column:
    return F.when(count > threshold, 2).otherwise(1)


def auto_query_chunks(count: Column, per_chunk: int = 7500) -> Column:
    return F.greatest(F.lit(1), F.bround(count / per_chunk).cast("int"))


def expand_per_scale(value, num_scales: int) -> list:
    """One value for each scale; a list must have as many."""
    out = list(value) if isinstance(value, list | tuple) else [value] * num_scales
    if len(out) != num_scales:
        raise ValueError(f"{len(out)} values for {num_scales} scales")
    return out


def sampling_plan(catalog: DataFrame, num_scales: int | None, patch: int, steps=10, rho=0.2, dataset_stride=1, min_short: int | None = None,
                  backend_from: int = 250_000, stride_from: int = 8_000_000, per_chunk: int = 7500) -> DataFrame:
    """One row for each image and scale of catalog (image_id, height, width, and sample_height, sample_width if they differ).

    Depth, backend, stride and chunks come from the sizes that govern them: the depth from the least side of image and
    sample (None: each image its own, down to min_short, 1.7 patches if None; per-scale lists need one depth for all), the
    backend from the image's patches, stride and chunks from the sample's. patches: what the image's dataset holds.
    """
    default = min_short or int(round(1.7 * patch))
    if "sample_height" not in catalog.columns:
        catalog = catalog.withColumns({"sample_height": F.col("height"), "sample_width": F.col("width")})
    if num_scales is None:
        if any(isinstance(v, list | tuple) for v in (steps, rho, dataset_stride)):
            raise ValueError("values by scale need a number of scales")
        depth = auto_num_scales(F.least("height", "width", "sample_height", "sample_width"), F.lit(default))
    else:
        depth = F.lit(num_scales)
    sized = catalog.withColumn("num_scales", depth)
    value = lambda v: F.element_at(F.array(*map(F.lit, expand_per_scale(v, num_scales))), F.col("scale") + 1) if num_scales else F.lit(v)
    scales = sized.withColumn("scale", F.explode(F.sequence(F.lit(0), F.col("num_scales") - 1)))
    sides = {c: scale_side(c, F.col("num_scales"), min_short) for c in ("height", "width")}
    sample = {f"sample_{c}": scale_side(c, F.col("num_scales"), min_short, "sample_") for c in ("height", "width")}
    plan = scales.select("image_id", "num_scales", "scale", *(x.alias(c) for c, x in (sides | sample).items()), value(dataset_stride).alias("dataset_stride"),
                         value(steps).alias("steps"), value(rho).cast("double").alias("rho"))
    windows = lambda side: F.greatest(F.floor((F.col(side) - patch) / F.col("dataset_stride")) + 1, F.lit(0))
    counts = patch_count(F.col("height"), F.col("width"), patch)
    asked = patch_count(F.col("sample_height"), F.col("sample_width"), patch)
    return plan.select("*", (windows("height") * windows("width")).alias("patches"), (F.least("height", "width") / patch).alias("short_in_patches"),
                       auto_backend(counts, backend_from).alias("backend"), auto_query_stride(asked, stride_from).alias("stride"),
                       auto_query_chunks(asked, per_chunk).alias("chunks"))


def uniform_columns(plan: DataFrame, columns: list[str]) -> DataFrame:
    """(image_id, column, value) of the plan columns that hold one value over all scales of an image."""
    flat = plan.select("image_id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e"))
    return flat.groupBy("image_id", "e.column").agg(F.count_distinct("e.value").alias("n"), F.min("e.value").alias("value")).where("n = 1").drop("n")


def collapse_stages(log: DataFrame) -> DataFrame:
    """(run_id, label, total, count, mean, first_seq, nested of the first) of a log of stages."""
    return log.groupBy("run_id", "label").agg(F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("count"), F.avg("seconds").alias("mean"),
                                              F.min("seq").alias("first_seq"), F.min_by("nested", "seq").alias("nested"))


def run_breakdown(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, counted, core, residual, core_percent): core leaves out nested stages, loading and image writing."""
    core = ~F.col("nested") & (F.col("kind") != "load") & ~F.col("label").startswith("image writing")
    sums = log.groupBy("run_id").agg(F.coalesce(F.sum(F.when(~F.col("nested"), F.col("seconds"))), F.lit(0.0)).alias("counted"),
                                     F.coalesce(F.sum(F.when(core, F.col("seconds"))), F.lit(0.0)).alias("core"))
    return sums.join(runs, "run_id").select("run_id", "counted", "core", (F.col("wall") - F.col("counted")).alias("residual"), (100 * F.col("core") / F.col("wall")).alias("core_percent"))


def net_of_io(stages: DataFrame, io: DataFrame) -> DataFrame:
    """Stages (run_id, seq, start, seconds) less the I/O (run_id, start, seconds) that began inside them.

    No stage meets an I/O: the I/O before a stage's end less that before its start is what began inside, and both come from
    running sums over ends, starts and I/O of a run, in order of time. Stages that share run_id, seq and seconds count as one;
    null starts and lengths have no I/O.
    """
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("seconds")).alias("at"), F.lit(1).alias("sign"))))
    marks = stages.where("start is not null and seconds > 0 and run_id is not null").select("run_id", "seq", "seconds", ends.alias("e")).select("run_id", "seq", "seconds", "e.*")
    # an I/O that begins at the very time of an end or a start comes after it
    events = marks.select("run_id", "at", F.lit(0).alias("kind"), "seq", "seconds", "sign", F.lit(None).cast("double").alias("io")).unionByName(
        io.where("run_id is not null and start is not null").select("run_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(stages.schema["seq"].dataType).alias("seq"),
                                                                    F.lit(None).cast(stages.schema["seconds"].dataType).alias("seconds"), F.lit(0).alias("sign"), F.col("seconds").cast("double").alias("io")))
    sums = running_sums(events, ["run_id"], ["at", "kind", "seq"], "io").where("kind = 0")
    inside = sums.groupBy("run_id", "seq", "seconds").agg(F.sum(F.col("before") * F.col("sign")).alias("io"))
    return stages.select("run_id", "seq", "seconds").distinct().join(inside, ["run_id", "seq", "seconds"], "left").select(
        "run_id", "seq", (F.col("seconds") - F.coalesce("io", F.lit(0.0))).alias("net"))


def mark_phase(log: DataFrame) -> DataFrame:
    """Adds phase: inside sampling (nested), sampling (a label that computes somewhere), or setup."""
    compute = log.where("kind = 'compute'").select("label").distinct().withColumn("computes", F.lit(True))
    return log.join(compute, "label", "left").withColumn("phase", F.when(F.col("nested"), "inside sampling").when(F.col("computes"), "sampling").otherwise("setup")).drop("computes")
