"""Properties of the image and vector operators, and every query against its SQL on the smallest tables."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchspark.functions import geometry as g
from patchspark.functions import schedule as n
from patchspark.operators import kernel as k
from patchspark.operators import layout as lo
from patchspark.operators import measures as m
from patchspark.operators import patches as w
from patchspark.operators import resample as r
from patchspark.plans import catalogue as c
from patchspark.queries import QUERIES, SQL
from patchspark.sources import tables

SF = "/root/testdata/sf0.001"


def image(spark, h, w_, f=lambda c, y, x: float(c + y * 7 + x * 3) % 5):
    return spark.createDataFrame([(1, c, y, x, f(c, y, x)) for c in range(3) for y in range(h) for x in range(w_)], "image_id int, c int, y int, x int, v double")


def values(df):
    return sorted((*t[:-1], round(t[-1], 9)) for t in map(tuple, df.select("image_id", "c", "y", "x", "v").collect()))


def test_fold_of_extract_is_the_image(spark):
    px = image(spark, 5, 6)
    assert values(w.fold(w.extract_patches(px, 3), px, 0.5, 3)) == values(px)


@pytest.mark.parametrize("p,stride,band", [(1, 1, 3), (3, 1, 1), (3, 2, 3), (3, 1, 64), (5, 1, 2), (8, 1, 3)])
def test_bands_change_nothing(spark, p, stride, band):
    """Windows and folds against numpy, for bands smaller and larger than the window; H = P and P = 1 too."""
    px = image(spark, 8, 9, lambda c, y, x: float(np.sin(c + y * 7 + x * 3.5)))
    a = np.sin(np.arange(3)[:, None, None] + np.arange(8)[:, None] * 7 + np.arange(9) * 3.5)
    want = {(y, x): a[:, y : y + p, x : x + p].ravel() for y in range(0, 9 - p, stride) for x in range(0, 10 - p, stride)}
    patches = w.extract_patches(px, p, stride, band)
    got = {(t["py"], t["px"]): t["v"] for t in patches.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    weights, total, under = w.window_weights(p, 0.7), np.zeros_like(a), np.zeros_like(a)
    for (y, x), v in want.items():
        total[:, y : y + p, x : x + p] += weights * v.reshape(3, p, p) * (1 + y)
        under[:, y : y + p, x : x + p] += weights
    out = w.fold(patches.withColumn("v", F.transform("v", lambda e: e * (1 + F.col("py")))), px, 0.7, p, stride, band)
    want = np.where(under > 0, total / np.where(under > 0, under, 1), 0)
    rows = out.collect()
    assert len(rows) == 216 and all(abs(t["v"] - want[t["c"], t["y"], t["x"]]) < 1e-9 for t in rows)


def test_image_smaller_than_the_window_has_no_patches(spark):
    assert w.extract_patches(image(spark, 2, 9), 3).count() == 0 and w.extract_patches(image(spark, 9, 2), 3).count() == 0


def test_window_table_is_the_array(spark):
    for p, rho in ((1, 0.5), (4, 0.3), (3, float("inf"))):
        a = w.window_weights(p, rho)
        assert all(abs(t["w"] - a[t["dy"], t["dx"]]) < 1e-12 for t in w.gaussian_window(spark, p, rho).collect())


@pytest.mark.parametrize("name", list(r.WIDTHS))
def test_taps_are_the_contributions(spark, name):
    pairs = [(9, 5), (5, 9), (7, 7), (64, 3), (3, 64)]
    for antialias in (True, False):
        shapes = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "image_id int, n_in int, n_out int")
        got = {(t["image_id"], t["out_idx"], t["in_idx"]): t["w"] for t in r.contributions(shapes, name, antialias).collect()}
        for i, (n_in, n_out) in enumerate(pairs):
            places, weights = r.taps(n_in, n_out, name, antialias)
            dense = np.zeros((n_out, n_in))
            np.add.at(dense, (np.arange(n_out)[:, None], places), weights)
            assert all(abs(dense[o, k] - got.get((i, o, k), 0.0)) < 1e-9 for o in range(n_out) for k in range(n_in))


def test_bands_of_resizing_change_nothing(spark):
    px = image(spark, 7, 10)
    to = spark.createDataFrame([(1, 4, 13)], "image_id int, height int, width int")
    one = values(r.resize(px, to))
    assert all(np.allclose([t[-1] for t in values(r.resize(px, to, band=b))], [t[-1] for t in one]) for b in (1, 3)) and len(one) == 3 * 4 * 13
    assert g.sizes(r.resize_by(px, 0.45)).first()[1:] == (4, 5)


def test_stride_leaves_uncovered_pixels_zero(spark):
    px = image(spark, 4, 5, lambda c, y, x: 1.0)
    rows = w.fold(w.extract_patches(px, 3, 2), px, float("inf"), 3, 2).collect()
    assert {t["v"] for t in rows if t["y"] == 3} == {0.0} and {t["v"] for t in rows if t["y"] < 3} == {1.0}


def test_roll_and_back(spark):
    px = image(spark, 5, 6)
    assert values(g.roll(g.roll(px, "diag"), "diag", back=True)) == values(px)


@pytest.mark.parametrize("axis,source", [("horizontal", "right"), ("vertical", "top"), ("vertical", "bottom")])
def test_symmetrized_is_symmetric(spark, axis, source):
    out = g.symmetrize(image(spark, 5, 7), axis, source)
    assert out.count() == 105 and m.mirror_asymmetry(out, axis).first()["asymmetry"] == 0


def test_contributions_sum_to_one_and_constant_stays(spark):
    shapes = spark.createDataFrame([(1, 9, 5), (2, 5, 9), (3, 7, 7)], "image_id int, n_in int, n_out int")
    for name in r.WIDTHS:
        for t in r.contributions(shapes, name).groupBy("image_id", "out_idx").agg(F.sum("w").alias("w")).collect():
            assert abs(t["w"] - 1) < 1e-6
    px = image(spark, 6, 5, lambda c, y, x: 0.25)
    to = spark.createDataFrame([(1, 3, 8)], "image_id int, height int, width int")
    out = r.resize(px, to).collect()
    assert len(out) == 72 and all(abs(t["v"] - 0.25) < 1e-9 for t in out)


def test_kernel_blocks_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 4)), rng.normal(size=(50, 4))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, x array<double>")
    v = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(y)], "vec_id long, v array<double>")
    for alpha, sigma in ((0.6, 0.4), (0.9, 1e-3)):
        logit = -((x[:, None] - alpha * y[None]) ** 2).sum(2) / (2 * sigma**2)
        p = np.exp(logit - logit.max(1, keepdims=True))
        want = p @ y / p.sum(1, keepdims=True)
        for rows in (4096, 9):
            got = {t["query_id"]: t["x_hat"] for t in k.kernel_regress(q, v, alpha, sigma, rows).collect()}
            assert all(np.allclose(got[i], want[i]) for i in range(7))
        every = k.knn_regress(q, v, k.knn_flat(q, v, 99), alpha, sigma).collect()
        assert all(np.allclose(t["x_hat"], want[t["query_id"]]) for t in every)
    exact = sorted(map(tuple, k.knn_flat(q, v, 3).select("query_id", "rank", "vec_id").collect()))
    assert sorted(map(tuple, k.knn_flat(q, v, 3, 4).select("query_id", "rank", "vec_id").collect())) == exact
    ivf = lo.lay_out(v, nlist=5)
    assert sorted(map(tuple, lo.knn_ivf(q, ivf, 3, 5).select("query_id", "rank", "vec_id").collect())) == exact
    assert sorted(map(tuple, lo.knn_ivf(q, ivf, 3, 1, recall=1.0).select("query_id", "rank", "vec_id").collect())) == exact
    with pytest.raises(ValueError):
        k.require_k(k.knn_flat(q, v, 3), q, 4)


def test_schedules(spark):
    for num in (1, 2, 50):
        rows = n.flow_linear(spark, num).orderBy("t").collect()
        assert rows[0][1:] == (1.0, 0.0) and all(abs(t["alpha"] + t["sigma"] - 1) < 1e-12 for t in rows) and len(rows) == num + 1
    with pytest.raises(ValueError):
        n.ve_edm(spark, 1)
    sigma = [t["sigma"] for t in n.ve_edm(spark, 6).orderBy("t").collect()]
    assert sigma[0] == 0 and sigma == sorted(sigma) and abs(sigma[-1] - 80) < 1e-9 and abs(sigma[1] - 0.002) < 1e-9


def test_plan_errors(spark):
    with pytest.raises(ValueError):
        c.expand_per_scale([1, 2], 3)
    with pytest.raises(ValueError):
        w.check_patchable(spark.createDataFrame([(1, 0, 4, 9)], "image_id int, scale int, height int, width int"), 5)
    bad = spark.createDataFrame([("(12",)], "req string").select(g.requested_size(F.col("req"), F.lit(1), F.lit(2))[0].alias("h"))
    with pytest.raises(Exception, match="not a size"):
        bad.collect()


def test_searches_stay_within_groups(spark):
    """Lists by group against numpy, with ties, and a group that has no queries."""
    rng = np.random.default_rng(1)
    y = rng.normal(size=(90, 3))
    y[40:50] = y[30:40]
    v = spark.createDataFrame([(i % 3, i, u.tolist()) for i, u in enumerate(y)], "group int, vec_id long, v array<double>")
    x = rng.normal(size=(20, 3))
    q = spark.createDataFrame([(i % 2, i, u.tolist()) for i, u in enumerate(x)], "group int, query_id long, x array<double>")
    want = {}
    for i, u in enumerate(x):
        own = [j for j in range(90) if j % 3 == i % 2]
        want[i] = sorted(own, key=lambda j: (((y[j] - u) ** 2).sum(), j))[:4]
    for found in (k.knn_flat(q, v, 4, 7, on=["group"]), lo.knn_ivf(q, lo.lay_out(v, ["group"], 4), 4, 4)):
        got = {}
        for t in found.orderBy("query_id", "rank").collect():
            got.setdefault(t["query_id"], []).append(t["vec_id"])
        assert got == want
    means = {t["group"]: t["mean"] for t in lo.group_means(lo.lay_out(v, ["group"], 4)).collect()}
    assert all(np.allclose(means[i], y[i::3].mean(0)) for i in range(3))
    assert k.knn_flat(q.limit(0), v, 4, on=["group"]).count() == 0 and k.knn_flat(q.drop("group"), v.limit(0).drop("group"), 4).count() == 0


def test_plan_sizes(spark):
    rows = spark.createDataFrame([(1, 100, 60, "(30, 200)"), (2, 64, 64, None), (3, 40, 50, " ( 40 ,50 ) ")], "image_id int, height int, width int, request string")
    sized = g.sample_sizes(rows)
    assert [tuple(t)[-2:] for t in sized.orderBy("image_id").collect()] == [(30, 200), (64, 64), (40, 50)]
    plan = c.sampling_plan(sized, None, 7, backend_from=3000).orderBy("image_id", "scale").collect()
    # min(100, 60, 30, 200) = 30 = 12 * 2.5 -> 3 scales; 64 -> 4; 40 -> 3
    assert [sum(t["image_id"] == i for t in plan) for i in (1, 2, 3)] == [3, 4, 3]
    assert [t["backend"] for t in plan if t["scale"] == 0] == ["ann", "ann", "exact"]
    with pytest.raises(ValueError):
        c.sampling_plan(sized, None, 7, [1, 2])
    with pytest.raises(ValueError):
        m.templates("xr")
    assert len(m.templates("hr")) == 14 and len(m.templates("lr")) == 26


def test_trace_by_scale(spark, tmp_path):
    for scale in (1, 0):
        tables.write_table(image(spark, 2, 2).withColumn("scale", F.lit(scale)), str(tmp_path / "trace"))
    assert tables.read_table(spark, str(tmp_path / "trace")).count() == 24 and tables.read_table(spark, str(tmp_path / "trace"), 1).count() == 12


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    from patchspark.sources import steps

    class Conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf

    with pytest.raises(ValueError, match="share"):
        steps.scratch(Session, "x")


#: Searches that are approximate by nature; test_files_and_index.py measures their recall.
NO_SQL = {"nearest_ivf", "nearest_quantised", "quantised_regression"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL and not any("vec_id %" in text for text in SQL.values())


#: Whole runs of samplers, minutes each: of these one run, one inversion and one pair are held against SQL here.
LONG = {"sampled_often", "retargeted", "sampled_symmetric", "sampled_tileable", "inverted_and_back", "guided", "recalls", "traced"}


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL and name not in LONG])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(repr, got[cols].astype(object).values.tolist())) == sorted(map(repr, want[cols].astype(object).values.tolist()))


def test_quantised_regression_takes_all(spark):
    got = QUERIES["quantised_regression"](spark, SF).select("query_id").distinct().count()
    assert got == spark.read.parquet(f"{SF}/embeddings.parquet").count()
