"""Dense images by bands of lines, for images of any size: no task, row or array holds more than a band.

A band is a row (image_id, height, width, channels, top, lines, data): `lines` lines from `top` on, channel by channel. A PNG
goes out as bands that are deflated side by side, each to a stretch of the stream that needs nothing before it, and then
joined; it comes in as a stream that is inflated a band at a time.
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

from patchspark.functions.geometry import sizes
from patchspark.sources.files import SIGNATURE, chunk, file_system, header, scanlines
from patchspark.sources.steps import kept

#: Numbers of a band, and bytes that are read or inflated at once.
CELLS, PIECE = 1 << 21, 1 << 20
#: The modulus of the checksum at the end of a deflated stream, the stream's first bytes, and its empty last block.
ADLER, STREAM, LAST_BLOCK = 65521, b"\x78\x9c", b"\x03\x00"
#: Bytes a pixel of grey, colour, palette, grey with alpha and colour with alpha.
BYTES_A_PIXEL = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SCHEMA = "height int, width int, channels int, top int, lines int, data array<double>"


def band_lines(width: Column, channels: Column, cells: int = CELLS) -> Column:
    """Lines of a band: as many as `cells` numbers allow, one at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(cells) / (width * channels))).cast("int")


def to_bands(px: DataFrame, cells: int = CELLS) -> DataFrame:
    """Bands of long-form pixels. Pixels that are missing are 0, of repeated ones one is taken."""
    dims = sizes(px).join(px.groupBy("image_id").agg((F.max("c") + 1).alias("channels")), "image_id")
    dims = dims.select("image_id", *(F.col(c).cast("int").alias(c) for c in ("height", "width", "channels")))
    placed = px.join(dims.withColumn("lines", band_lines(F.col("width"), F.col("channels"), cells)), "image_id")

    def dense(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        h, w, n, step = (int(first[k]) for k in ("height", "width", "channels", "lines"))
        top = int(first["y"]) // step * step
        data = np.zeros((n, min(step, h - top), w))
        data[part["c"], part["y"] - top, part["x"]] = part["v"]
        return pd.DataFrame({"image_id": [first["image_id"]], "height": h, "width": w, "channels": n, "top": top, "lines": data.shape[1], "data": [data.ravel()]})

    key = px.schema["image_id"].dataType.simpleString()
    return placed.groupBy("image_id", F.floor(F.col("y") / F.col("lines")).alias("band")).applyInPandas(dense, f"image_id {key}, {SCHEMA}")


def band_pixels(bands: DataFrame) -> DataFrame:
    """Long-form pixels of bands."""
    flat = bands.select("image_id", "width", "top", "lines", F.posexplode("data").alias("i", "v"))
    line = F.floor(F.col("i") / F.col("width"))
    return flat.select("image_id", F.floor(line / F.col("lines")).cast("int").alias("c"), (F.col("top") + line % F.col("lines")).cast("int").alias("y"),
                       (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def joined_checksum(parts: list[tuple[int, int]]) -> int:
    """Adler-32 of bytes one after another, from (checksum, length) of each."""
    a, b = 1, 0
    for checksum, length in parts:
        low, high = checksum & 0xFFFF, checksum >> 16
        a, b = (a + low - 1) % ADLER, (b + high + length * (a - 1)) % ADLER
    return b << 16 | a


def write_bands(bands: DataFrame, directory: str) -> DataFrame:
    """Writes one PNG for each path of bands (with a column path, relative to directory); returns (path, file, n_bytes).

    Each band is deflated in a task of its own and put beside the files; one task an image then copies the deflated bands
    behind one another, a piece at a time, with the checksum of the whole from those of the bands. Bands that leave a line
    out or hold it twice raise an error. Paths that are null are left out. Files appear whole; tasks may run twice. All
    executors and the driver must reach directory.
    """
    store = f"{directory.rstrip('/')}/.parts-{uuid.uuid4().hex}"

    def deflated(part: pd.DataFrame) -> pd.DataFrame:
        system, root = file_system(store)
        out = []
        for row in part.itertuples():
            raw = scanlines(np.asarray(row.data, float).reshape(row.channels, row.lines, row.width))
            squeeze = zlib.compressobj(wbits=-15)
            body = squeeze.compress(raw) + squeeze.flush(zlib.Z_FULL_FLUSH)
            name = uuid.uuid4().hex
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}") as to:
                to.write(body)
            out.append((row.path, row.height, row.width, row.channels, row.top, row.lines, name, zlib.adler32(raw), len(raw), len(body)))
        return pd.DataFrame(out, columns=["path", "height", "width", "channels", "top", "lines", "part", "checksum", "raw", "n_bytes"])

    def assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (system, root), (_, parts_at) = file_system(directory), file_system(store)
        for batch in batches:
            done = []
            for row in batch.itertuples():
                parts = sorted((dict(p) if isinstance(p, dict) else p.asDict() for p in row.parts), key=lambda p: p["top"])
                ends = np.cumsum([p["lines"] for p in parts])
                if [p["top"] for p in parts] != [0, *ends[:-1]] or ends[-1] != row.height:
                    raise ValueError(f"the bands of {row.path} don't make {row.height} lines")
                target = f"{root.rstrip('/')}/{row.path}"
                folder, _, name = target.rpartition("/")
                system.create_dir(folder, recursive=True)
                draft, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0

                with system.open_output_stream(draft) as out:
                    def put(body: bytes, out=out) -> int:
                        out.write(body)
                        return len(body)

                    size += put(SIGNATURE + header(row.height, row.width, row.channels) + chunk(b"IDAT", STREAM))
                    for p in parts:
                        size += put(struct.pack(">I", p["n_bytes"]) + b"IDAT")
                        check = zlib.crc32(b"IDAT")
                        with system.open_input_stream(f"{parts_at}/{p['part']}") as come:
                            while piece := come.read(PIECE):
                                check = zlib.crc32(piece, check)
                                size += put(piece)
                        size += put(struct.pack(">I", check))
                    whole = joined_checksum([(p["checksum"], p["raw"]) for p in parts])
                    size += put(chunk(b"IDAT", LAST_BLOCK + struct.pack(">I", whole)) + chunk(b"IEND", b""))
                system.move(draft, target)
                done.append((row.path, f"{directory.rstrip('/')}/{row.path}", size))
            yield pd.DataFrame(done, columns=["path", "file", "n_bytes"])

    rows = bands.where("path is not null").select("path", "height", "width", "channels", "top", "lines", "data")
    parts = kept(rows.groupBy("path", "top").applyInPandas(
        deflated, "path string, height int, width int, channels int, top int, lines int, part string, checksum long, raw long, n_bytes long"))
    # what a group lists is some fifty bytes a band
    images = parts.groupBy("path", "height", "width", "channels").agg(F.collect_list(F.struct("top", "lines", "part", "checksum", "raw", "n_bytes")).alias("parts"))
    files = kept(images.mapInPandas(assembled, "path string, file string, n_bytes long"))
    system, root = file_system(store)
    if system.get_file_info(root).type.name == "Directory":
        system.delete_dir(root)
    return files


def _chunks(stream) -> Iterator[tuple[bytes, bytes]]:
    """(kind, piece) of a PNG stream's chunks, PIECE bytes at a time; each chunk's checksum is held against its bytes."""
    if stream.read(len(SIGNATURE)) != SIGNATURE:
        raise ValueError("not a PNG file")
    kind = b""
    while kind != b"IEND":
        left, kind = struct.unpack(">I4s", stream.read(8))
        check = zlib.crc32(kind)
        if left == 0:
            yield kind, b""
        while left:
            piece = stream.read(min(left, PIECE))
            if not piece:
                raise ValueError("a PNG file ends too soon")
            left, check = left - len(piece), zlib.crc32(piece, check)
            yield kind, piece
        if struct.unpack(">I", stream.read(4))[0] != check:
            raise ValueError(f"a {kind.decode('latin-1')} chunk of a PNG file is damaged")


def unfiltered(lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """(lines, width, bytes) from filtered lines of the same shape with their filter in front, and the line above them.

    Lines whose filter looks at one neighbour are summed line by line. The others are undone along diagonals: a pixel needs
    what is left, above, and above left of it, so all pixels of a diagonal are ready at once.
    """
    kinds, n = lines[:, 0], above.shape[1]
    raw = lines[:, 1:].reshape(len(lines), len(above), n)
    if kinds.max(initial=0) > 4:
        raise ValueError(f"no filter: {kinds.max()}")
    if kinds.max(initial=0) < 3:
        out = np.empty_like(raw)
        for i, kind in enumerate(kinds):
            out[i] = raw[i] if kind == 0 else np.cumsum(raw[i], axis=0, dtype=np.uint8) if kind == 1 else raw[i] + above
            above = out[i]
        return out
    h, w = raw.shape[:2]
    # line r (0 is the one above) has its pixel x at [r + x + 1, r]; what is left of it stays 0
    at = np.zeros((h + w + 1, h + 1, n), np.int16)
    r, x = np.arange(h + 1)[:, None], np.arange(w)[None, :]
    at[r + x + 1, r] = np.concatenate([above[None], raw])
    is_kind = [(kinds == k)[:, None] for k in range(5)]
    for d in range(2, h + w + 1):
        lo, hi = max(1, d - w), min(h, d - 1)
        rows = slice(lo - 1, hi)  # of the lines above, and of raw
        left, up, corner = at[d - 1, lo : hi + 1], at[d - 1, rows], at[d - 2, rows]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.select([k[rows] for k in is_kind], [np.int16(0), left, up, (left + up) >> 1, nearest])
        at[d, lo : hi + 1] = (at[d, lo : hi + 1] + guess) & 255
    return at[r + x + 1, r][1:].astype(np.uint8)


def png_bands(stream, cells: int = CELLS) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(height, width, top, (3, lines, width) in [0, 1]) of the bands of a PNG stream with 8 bits a channel.

    Alpha is dropped, grey is repeated. Other depths and interlaced files raise an error: read_images() takes them whole.
    """
    buffer, palette, inflate = bytearray(), None, zlib.decompressobj()
    h = w = colour = top = 0
    above = np.zeros((0, 0), np.uint8)
    for kind, piece in _chunks(stream):
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", piece)
            if depth != 8 or interlaced:
                raise ValueError(f"bands need 8 bits a channel and no interlace, not {depth} and {interlaced}")
            above = np.zeros((w, BYTES_A_PIXEL[colour]), np.uint8)
            step = max(1, cells // (w * 3))
        elif kind == b"PLTE":
            palette = np.frombuffer((b"" if palette is None else palette.tobytes()) + piece, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            while piece:
                buffer += inflate.decompress(piece, PIECE)
                piece, size = inflate.unconsumed_tail, 1 + above.size
                while top < h and len(buffer) >= (n := min(step, h - top)) * size:
                    lines = unfiltered(np.frombuffer(bytes(buffer[: n * size]), np.uint8).reshape(n, size), above)
                    del buffer[: n * size]
                    above = lines[-1]
                    seen = palette[lines[:, :, 0]] if colour == 3 else lines[:, :, :3] if colour in (2, 6) else np.repeat(lines[:, :, :1], 3, axis=2)
                    yield h, w, top, seen.transpose(2, 0, 1) / 255.0
                    top += n
    if top < h:
        raise ValueError(f"a PNG file of {h} lines ends after {top}")


def read_bands(spark: SparkSession, path: str, recursive: bool = False, cells: int = CELLS) -> DataFrame:
    """Bands of the PNG files under path, in [0, 1]; image_id is the file's address. A file is one task's stream, held a band at a time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][nN][gG]").option("recursiveFileLookup", recursive).load(path).select("path")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                system, at = file_system(file)
                with system.open_input_stream(at) as stream:
                    for h, w, top, data in png_bands(stream, cells):
                        yield pd.DataFrame({"image_id": [file], "height": h, "width": w, "channels": 3, "top": top, "lines": data.shape[1], "data": [data.ravel()]})

    return found.mapInPandas(bands, f"image_id string, {SCHEMA}")
