"""Images, vectors and catalogues as tables: dense and long forms, 8-bit values, sample plans, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vectors(spark, sf_dir: str) -> DataFrame:
    """(vec_id, v, label) of the embeddings, in double precision."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def pixels(spark, sf_dir: str) -> DataFrame:
    """Long-form images (image_id, c, y, x, v) whose lines are the vectors of a label, three channels in turn."""
    by = Window.partitionBy("label")
    lines = vectors(spark, sf_dir).select(
        F.col("label").alias("image_id"), "v", (F.row_number().over(by.orderBy("vec_id")) - 1).alias("r"), F.count(F.lit(1)).over(by).alias("n"))
    y = F.floor(F.col("r") / 3).cast("int")
    lines = lines.where(y < F.floor(F.col("n") / 3)).select("image_id", (F.col("r") % 3).alias("c"), y.alias("y"), F.posexplode("v").alias("x", "e"))
    return lines.select("image_id", "c", "y", "x", F.greatest(F.least(F.col("e") * 4, F.lit(1.0)), F.lit(-1.0)).alias("v"))


def to_images(px: DataFrame) -> DataFrame:
    """Dense images (image_id, height, width, channels, data), channel by channel, from long-form pixels."""
    return px.groupBy("image_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("c") + 1).alias("channels"),
        F.transform(F.array_sort(F.collect_list(F.struct("c", "y", "x", "v"))), lambda e: e["v"]).alias("data"))


def to_pixels(images: DataFrame) -> DataFrame:
    """Long-form pixels from dense images."""
    area = F.col("height") * F.col("width")
    flat = images.select("image_id", "width", area.alias("area"), F.posexplode("data").alias("i", "v"))
    place = F.col("i") % F.col("area")
    return flat.select("image_id", F.floor(F.col("i") / F.col("area")).cast("int").alias("c"),
                       F.floor(place / F.col("width")).cast("int").alias("y"), (place % F.col("width")).cast("int").alias("x"), "v")


def to_uint8(v: Column) -> Column:
    """[0, 1] to 0..255: clamped, then cut off, not rounded."""
    return F.greatest(F.least(v * 255, F.lit(255.0)), F.lit(0.0)).cast("int")


def sample_plan(images: DataFrame) -> DataFrame:
    """(image_id, sample_id, seed, path) from (image_id, n, seed, path): seeds count up; paths get _000 if n > 1."""
    each = images.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    stem, ext = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    path = F.when(F.col("n") > 1, F.format_string("%s_%03d%s", stem, "sample_id", ext)).otherwise(F.col("path"))
    return each.select("image_id", "sample_id", (F.col("seed") + F.col("sample_id")).alias("seed"),
                       F.when(F.col("path").isNotNull(), path).alias("path"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def pending_assets(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Assets not in place: a file until it is listed, an archive until its directory lists anything."""
    files = manifest.where(~F.col("archive")).join(listing.select("target").distinct(), "target", "left_anti")
    dirs = listing.select(parent(F.col("target")).alias("dir")).distinct()
    archives = manifest.where("archive").withColumn("dir", parent(F.col("target"))).join(dirs, "dir", "left_anti").drop("dir")
    return files.unionByName(archives)


def set_status(manifest: DataFrame, pending: DataFrame) -> DataFrame:
    """(set_name, assets, missing, state) of each set."""
    missing = pending.select("set_name", "asset", F.lit(1).alias("gone"))
    counts = manifest.join(missing, ["set_name", "asset"], "left").groupBy("set_name").agg(
        F.count(F.lit(1)).alias("assets"), F.count("gone").alias("missing"))
    state = F.when(F.col("missing") == 0, F.lit("in place")).otherwise(F.format_string("%d of %d missing", "missing", "assets"))
    return counts.withColumn("state", state)


def short_transfers(transfers: DataFrame) -> DataFrame:
    """Transfers whose written bytes are not those expected, where that is known."""
    return transfers.where("expected is not null and written <> expected")


def write_table(px: DataFrame, path: str) -> None:
    """Writes results (..., scale) as Parquet, one folder a scale: the trace of a coarse-to-fine run.

    Scales that are written again are replaced, others stay, so a run that is repeated leaves what one run does.
    """
    px.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scale").parquet(path)


def write_scale(px: DataFrame, path: str, scale: int) -> None:
    """Writes the result of one scale into its folder of the trace, in place of what was there; a marker tells that it is whole."""
    px.write.mode("overwrite").parquet(f"{path.rstrip('/')}/scale={scale}")


def read_scale(spark, path: str, scale: int) -> DataFrame:
    """The result that write_scale() wrote."""
    return spark.read.parquet(f"{path.rstrip('/')}/scale={scale}")


def whole_scales(spark, path: str) -> set[int]:
    """Scales of a trace that were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return set()
    found = [s.getPath() for s in files.listStatus(folder)]
    at = spark._jvm.org.apache.hadoop.fs.Path
    return {int(f.getName().removeprefix("scale=")) for f in found if f.getName().startswith("scale=") and files.exists(at(f, "_SUCCESS"))}


def read_table(spark, path: str, scale: int | None = None) -> DataFrame:
    """The trace written by write_table(), or one scale of it, of which only that folder is read."""
    trace = spark.read.parquet(path)
    return trace if scale is None else trace.where(F.col("scale") == scale)
