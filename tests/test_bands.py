"""Dense images by bands of lines."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchspark.sources import bands, files


def filtered(planes: np.ndarray, kinds, colour: int) -> bytes:
    """A PNG of (h, w, n) bytes whose line i has filter kinds[i], written pixel by pixel."""
    h, w, n = planes.shape
    out = bytearray()
    for y in range(h):
        out.append(kinds[y])
        for x in range(w):
            for c in range(n):
                left = int(planes[y, x - 1, c]) if x else 0
                up = int(planes[y - 1, x, c]) if y else 0
                corner = int(planes[y - 1, x - 1, c]) if x and y else 0
                p = left + up - corner
                paeth = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                out.append((int(planes[y, x, c]) - (0, left, up, (left + up) // 2, paeth)[kinds[y]]) % 256)
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    body = zlib.compress(bytes(out))
    plte = files.chunk(b"PLTE", bytes(range(256)) * 3) if colour == 3 else b""
    return (files.SIGNATURE + files.chunk(b"IHDR", head) + plte + files.chunk(b"IDAT", body[:7]) + files.chunk(b"IDAT", body[7:]) + files.chunk(b"IEND", b""))


@pytest.mark.parametrize("colour,n", [(0, 1), (2, 3), (3, 1), (4, 2), (6, 4)])
def test_all_filters(colour, n):
    rng = np.random.default_rng(colour)
    for h, w in ((1, 1), (7, 1), (1, 9), (23, 11), (9, 40)):
        seen = rng.integers(0, 256, (h, w, n), np.uint8)
        body = filtered(seen, rng.integers(0, 5, h), colour)
        want = np.frombuffer(bytes(range(256)) * 3, np.uint8).reshape(-1, 3)[seen[:, :, 0]] if n == 1 and colour == 3 else seen[:, :, :3] if n > 2 else np.repeat(seen[:, :, :1], 3, axis=2)
        for cells in (1, 100, 1 << 20):
            parts = list(bands.png_bands(io.BytesIO(body), cells))
            assert [p[2] for p in parts] == list(np.cumsum([0, *(p[3].shape[1] for p in parts)])[:-1])
            assert np.array_equal(np.rint(np.concatenate([p[3] for p in parts], axis=1) * 255), want.transpose(2, 0, 1))


def test_bad_files():
    good = files.png(np.zeros((3, 4, 4)))
    for body in (b"GIF89a" + good, good[:-20], good[:45] + bytes([good[45] ^ 1]) + good[46:], good[:8] + files.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 16, 2, 0, 0, 0)) + good[33:]):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            list(bands.png_bands(io.BytesIO(body)))


def test_checksums_of_parts_join():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 70_000, 3, 200_000)]
    assert bands.joined_checksum([(zlib.adler32(p), len(p)) for p in parts]) == zlib.adler32(b"".join(parts))
    assert bands.joined_checksum([]) == zlib.adler32(b"")


def test_bands_come_back_as_written(spark, tmp_path):
    """The spark image source, which knows nothing of bands, reads the same pixels."""
    rng = np.random.default_rng(3)
    shapes = {"a.png": (3, 37, 21), "sub/b.png": (1, 10, 1), "c.png": (3, 1, 50)}
    planes = {p: rng.integers(0, 256, s) for p, s in shapes.items()}
    rows = [(p, c, y, x, (int(v[c, y, x]) + 0.5) / 255) for p, v in planes.items() for c, y, x in np.ndindex(v.shape)]
    px = spark.createDataFrame(rows, "image_id string, c int, y int, x int, v double")
    cut = bands.to_bands(px, 256)
    assert cut.where("image_id = 'a.png'").count() == 10 and cut.agg(F.max(F.size("data"))).first()[0] <= 256
    assert sorted(bands.band_pixels(cut).collect()) == sorted(px.collect())
    out = f"file:{tmp_path}/out"
    done = bands.write_bands(cut.withColumn("path", F.col("image_id")), out).collect()
    assert {t["path"]: t["n_bytes"] for t in done} == {p: (tmp_path / "out" / p).stat().st_size for p in planes}
    assert not [p for p in (tmp_path / "out").rglob(".*") if not p.name.endswith(".crc")]
    for read in (files.read_images(spark, out, recursive=True), bands.read_bands(spark, out, recursive=True)):
        got = {t["image_id"].split("/out/")[1]: np.array(t["data"]).reshape(3, t["height"], t["width"]) for t in read.collect()}
        assert all(np.array_equal(np.rint(got[p] * 255), np.repeat(v, 3, 0) if len(v) == 1 else v) for p, v in planes.items())
    with pytest.raises(Exception, match="don't make 37 lines"):
        bands.write_bands(cut.where("top = 0").withColumn("path", F.col("image_id")), out)
    assert bands.write_bands(cut.where("top < 0").withColumn("path", F.col("image_id")), f"{out}-none").count() == 0
