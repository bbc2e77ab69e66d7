"""Image files, product-quantised search, and resizing by one side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchspark.operators import kernel as k
from patchspark.operators import layout as lo
from patchspark.operators import quantised as pq
from patchspark.operators import resample as r
from patchspark.sources import files, tables

SF = "/root/testdata/sf0.001"


def test_files_come_back_as_written(spark, tmp_path):
    rng = np.random.default_rng(3)
    planes = {name: rng.integers(0, 256, (n, h, w)) for name, n, h, w in (("a.png", 3, 5, 7), ("sub/dir/b.png", 1, 1, 1), ("c.png", 3, 1, 9))}
    # half a step more, since values are cut off, and some beyond the range
    rows = [(p, *x.shape[1:], len(x), ((x + 0.5) / 255).ravel().tolist()) for p, x in planes.items()] + [(None, 1, 1, 3, [0.0] * 3)]
    images = spark.createDataFrame(rows, "path string, height int, width int, channels int, data array<double>")
    done = files.write_images(images, f"file:{tmp_path}/out").collect()
    assert {t["path"] for t in done} == set(planes) and all(t["n_bytes"] == (tmp_path / "out" / t["path"]).stat().st_size for t in done)
    assert not [p for p in (tmp_path / "out").rglob(".*") if not p.name.endswith(".crc")]
    read = files.read_images(spark, f"{tmp_path}/out", recursive=True).collect()
    assert len(read) == 3
    for t in read:
        x = planes[t["image_id"].split("/out/")[1]]
        got = np.array(t["data"]).reshape(3, t["height"], t["width"]) * 255
        assert np.array_equal(np.rint(got).astype(int), np.repeat(x, 3, 0) if len(x) == 1 else x)
    with pytest.raises(ValueError):
        files.png(np.zeros((4, 2, 2)))


def test_preview_path(spark):
    rows = spark.createDataFrame([("a/b.c/x.png",), ("a.b/x",), (None,)], "p string").select(files.preview_path(F.col("p")).alias("q")).collect()
    assert [t["q"] for t in rows] == ["a/b.c/x_preview.png", "a.b/x_preview.png", None]


def test_parts():
    assert [pq.parts_of(d, w) for d, w in ((64, 16), (675, 16), (784, 28), (7, 16), (13, 12))] == [16, 15, 28, 7, 1]
    with pytest.raises(ValueError):
        pq.parts_of(8, 0)


def test_few_vectors_are_coded_exactly(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 12)), rng.normal(size=(60, 12))
    y[50:] = y[:10]  # repeated rows: ties by id
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, x array<double>")
    v = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(y)], "vec_id long, v array<double>")
    index = pq.fit_ivfpq(v, 5, pq_m=5)
    assert index.codebook.select("part").distinct().count() == 4 and index.codes.count() == 60
    want = {(t["query_id"], t["rank"]): t for t in k.knn_flat(q, v, 9).collect()}
    for rows in (4096, 4):
        got = pq.knn_ivfpq(q, index, 9, nprobe=5, rows=rows).collect()
        assert len(got) == 63 and all(abs(t["d2"] - want[t["query_id"], t["rank"]]["d2"]) < 1e-9 for t in got)
    assert len({tuple(t["code"]) for t in index.codes.where("vec_id >= 50 or vec_id < 10").collect()}) <= 20


@pytest.mark.parametrize("search", ["lists", "codes"])
def test_searches_find_nine_of_ten(spark, search):
    """Recall against the exact search, at few lists to begin with."""
    v = tables.vectors(spark, SF).select("vec_id", "v")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("x"))
    exact = {(t["query_id"], t["vec_id"]) for t in k.knn_flat(q, v, 10).collect()}
    found = lo.knn_ivf(q, lo.lay_out(v), 10, 1, recall=0.9) if search == "lists" else pq.knn_ivfpq(q, pq.fit_ivfpq(v), 10, 1, recall=0.9)
    assert len(exact & {(t["query_id"], t["vec_id"]) for t in found.collect()}) >= 0.88 * len(exact)


def test_scaled_queries_rank_alike(spark):
    rng = np.random.default_rng(5)
    q = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(rng.normal(size=(5, 6)))], "query_id long, x array<double>")
    v = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(rng.normal(size=(40, 6)))], "vec_id long, v array<double>")
    half = v.withColumn("v", F.transform("v", lambda e: 0.5 * e))
    order = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id").collect()))
    assert order(k.knn_flat(k.scale_queries(q, 0.5), v, 4)) == order(k.knn_flat(q, half, 4))
    with pytest.raises(ValueError):
        k.scale_queries(q, 0)


def catalog(spark, *rows):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(rows)], "image_id int, height int, width int")


def test_sides(spark):
    sizes = catalog(spark, (100, 50), (30, 45), (20, 20), (7, 5))
    assert [tuple(t)[1:] for t in r.short_side_sizes(sizes, 20).orderBy("image_id").collect()] == [(40, 20), (20, 30), (20, 20), (28, 20)]
    assert [tuple(t)[1:] for t in r.preview_sizes(sizes, 40).orderBy("image_id").collect()] == [(40, 20), (27, 40), (20, 20), (7, 5)]
    assert r.preview_sizes(sizes, None).collect() == sizes.collect()
    # halves go to the even side
    assert r.short_side_sizes(catalog(spark, (2, 5)), 1).first()[1:] == (1, 2)


def test_least_side_of_the_coarsest_scale(spark):
    def shapes(size, n, least):
        return [tuple(t)[2:] for t in r.pyramid_shapes(catalog(spark, size), n, least=least).orderBy("scale").collect()]

    assert shapes((100, 60), 3, 20) == [(100, 60), (50, 30), (34, 20)]
    assert shapes((100, 60), 3, 15) == [(100, 60), (50, 30), (25, 15)]
    assert shapes((100, 60), 3, 30) == [(100, 60), (50, 30), (50, 30)]
    assert shapes((100, 60), 1, 99) == [(100, 60)]
    with pytest.raises(Exception, match="too many scales"):
        shapes((100, 60), 3, 31)
