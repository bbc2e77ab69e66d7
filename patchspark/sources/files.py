"""Image files: any format that Spark's image source decodes comes in, PNG goes out.

An image is one row, read and written by one task; images are spread over tasks, and nothing passes through the driver.
Images too large for that go by bands of lines (bands.py).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from patchspark.sources.steps import kept

#: Fixed value: the first bytes of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


@F.pandas_udf(ArrayType(DoubleType()))
def _rgb(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Red, green and blue planes in [0, 1] from the source's lines of blue, green, red (and alpha), or of grey."""
    def planes(h: int, w: int, n: int, raw: bytes) -> np.ndarray:
        lines = np.frombuffer(raw, np.uint8).reshape(h, w, n)
        colours = np.repeat(lines, 3, axis=2) if n == 1 else lines[:, :, 2::-1]
        return colours.transpose(2, 0, 1).ravel() / 255.0

    return pd.Series([planes(*row) for row in zip(height, width, channels, data, strict=True)])


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Dense images (image_id, height, width, channels, data) of the files under path, in [0, 1]; image_id is the file's address.

    recursive: files in folders below count too. Alpha is dropped and grey is repeated to three channels. Files that are no images are left out.
    """
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive).load(path).select("image.*")
    return raw.select(F.col("origin").alias("image_id"), "height", "width", F.lit(3).alias("channels"), _rgb("height", "width", "nChannels", "data").alias("data"))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def header(height: int, width: int, channels: int) -> bytes:
    """The first chunk of an image of 8 bits a channel."""
    if channels not in (1, 3):
        raise ValueError(f"an image of {channels} channels has no PNG form")
    return chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0))


def scanlines(planes: np.ndarray) -> bytes:
    """The lines of (channels, height, width) in [0, 1], cut off to 8 bits, each after its filter, which is 0."""
    n, h, w = planes.shape
    lines = np.zeros((h, 1 + w * n), np.uint8)
    lines[:, 1:] = np.clip(planes * 255, 0, 255).astype(np.uint8).transpose(1, 2, 0).reshape(h, w * n)
    return lines.tobytes()


def png(planes: np.ndarray) -> bytes:
    """A PNG file of (channels, height, width) in [0, 1], one or three channels, cut off to 8 bits."""
    n, h, w = planes.shape
    return SIGNATURE + header(h, w, n) + chunk(b"IDAT", zlib.compress(scanlines(planes))) + chunk(b"IEND", b"")


def file_system(directory: str):
    """(file system, path) of a local path or an address such as file:/..., hdfs://... or s3://..."""
    from pyarrow import fs

    if directory.startswith("file:"):
        directory = "/" + directory.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)


def write_images(images: DataFrame, directory: str) -> DataFrame:
    """Writes one PNG for each dense image with a path (relative to directory); returns (path, file, n_bytes) of the files.

    Folders are made as needed. A file appears under its name only once it is whole, and the same image always gives
    the same bytes, so that a task that runs twice does no harm. Images whose path is null are left out. On a cluster,
    directory must be one that all executors reach.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(directory)
        for batch in batches:
            sizes = []
            for row in batch.itertuples():
                body = png(np.asarray(row.data, float).reshape(row.channels, row.height, row.width))
                target = f"{root.rstrip('/')}/{row.path}"
                folder, _, name = target.rpartition("/")
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(body)
                system.move(draft, target)
                sizes.append(len(body))
            yield pd.DataFrame({"path": batch["path"], "file": directory.rstrip("/") + "/" + batch["path"], "n_bytes": sizes})

    rows = images.where("path is not null").select("path", "height", "width", "channels", "data")
    return kept(rows.mapInPandas(write, "path string, file string, n_bytes long"))


def preview_path(path: Column) -> Column:
    """<name>_preview.png beside a path."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_preview.png"))
