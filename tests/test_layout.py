"""Laid-out vectors: same results as the plain forms, fewer rows looked at, and no move of what is laid out."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchspark.operators import kernel as k
from patchspark.operators import layout as lo


def close(a, b, key, value):
    a, b = ({tuple(r[c] for c in key): np.asarray(r[value], float) for r in df.collect()} for df in (a, b))
    assert set(a) == set(b) and all(np.allclose(a[i], b[i], rtol=0, atol=1e-9) for i in a)


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 12))
    x = centres[r.integers(0, 30, 3000)] + 0.05 * r.normal(size=(3000, 12))
    x[:1000] = x[0]  # a third of the rows are one vector
    v = spark.createDataFrame([(i % 2, i, row.tolist()) for i, row in enumerate(x)], "g int, vec_id long, v array<double>")
    q = spark.createDataFrame([(i % 2, i, (0.6 * row + 0.05 * r.normal(size=12)).tolist()) for i, row in enumerate(x[900:1300])], "g int, query_id long, x array<double>")
    return q.repartition(3), v.repartition(5)


def tuples(df, *names):
    return sorted(tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("on", [(), ("g",)])
def test_layout_equals_plain_forms(clustered, on):
    q, v = clustered
    laid = lo.lay_out(v, on)
    for sigma in (0.05, 3.0):
        close(lo.regress(q, laid, 0.6, sigma), k.kernel_regress(q, v.select(*on, "vec_id", "v"), 0.6, sigma, on=on), ["query_id"], "x_hat")
    want = tuples(k.knn_flat(q, v, 5, on=on), "query_id", "rank", "vec_id", "d2")
    assert tuples(lo.nearest(q, laid, 5), "query_id", "rank", "vec_id", "d2") == want
    assert tuples(lo.nearest(q, laid, 5, lo.LISTS), "query_id", "rank", "vec_id", "d2") == want
    small = lo.needed(q, laid, lo.reaching(0.6, 0.05, 1e-12)).first()
    assert 0 < small["scanned"] < 0.5 * small["rows"]
    assert lo.needed(q, laid, lo.reaching(0.6, 50.0, 1e-12)).first()["scanned"] == small["rows"] == q.join(v, "g").count() if on else True


def test_layout_is_not_moved(clustered):
    """The scan of the rows laid out has no exchange above it, in a regression and in a search."""
    q, v = clustered
    laid = lo.lay_out(v, ("g",))
    table = re.search(r"laid_\w+", laid.rows._jdf.queryExecution().toString())[0]
    for df in (lo.regress(q, laid, 0.6, 0.5), lo.nearest(q, laid, 5, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if x.strip()]
        at = next(i for i, x in enumerate(lines) if table in x and "Scan" in x)
        depth = lambda x: re.search(r"[A-Za-z(*]", x).start()
        above, now = [], depth(lines[at])
        for x in reversed(lines[:at]):
            if depth(x) < now:
                above.append(x)
                now = depth(x)
        join = next(i for i, x in enumerate(above) if "Join" in x)
        assert not any("Exchange" in x for x in above[:join]) and "Bucketed: true" in lines[at]


def test_copies_of_a_group_that_is_asked_often(spark, clustered, monkeypatch):
    q, v = clustered
    monkeypatch.setattr(lo, "SHARE", 60)
    monkeypatch.setattr(lo, "BLOCK", 32)
    laid = lo.lay_out(v, ("g",), queries=q.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    assert laid.lists.agg(F.max("copies")).first()[0] == 4
    close(lo.regress(q, laid, 0.6, 0.1), k.kernel_regress(q, v, 0.6, 0.1, on=("g",)), ["query_id"], "x_hat")


def test_audit_reaches_its_recall(clustered):
    q, v = clustered
    laid = lo.lay_out(v)
    nprobe = lo.audited_probes(q, laid, 5, 0.9)
    truth = k.knn_flat(q, v.select("vec_id", "v"), 5)
    hits = lo.nearest(q, laid, 5, nprobe).join(truth, ["query_id", "vec_id"], "left_semi").count()
    assert hits >= 0.85 * truth.count()


def test_layout_odd_groups(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [float("nan"), 1.0]), (2, 1, [3.0, 1.0]), (3, 5, [0.0, 0.0]), (3, 6, [0.0, 0.0])], "g int, vec_id long, v array<double>")
    q = spark.createDataFrame([(g, i, [1.0, 1.0]) for i, g in enumerate([1, 2, 3, 3, 4])], "g int, query_id long, x array<double>")
    laid = lo.lay_out(v.where("g <> 2"), ("g",))
    assert tuples(lo.nearest(q, laid, 2), "query_id", "rank", "vec_id", "d2") == [(0, 1, 0, 1.0), (2, 1, 5, 2.0), (2, 2, 6, 2.0), (3, 1, 5, 2.0), (3, 2, 6, 2.0)]
    assert lo.nearest(q.limit(0), laid, 2).count() == 0
    with pytest.raises(ValueError):
        lo.regress(q, laid, 0.6, 0.0)


def test_queries_travel_once_a_zone(clustered, monkeypatch):
    """Not once a cell: what is shuffled doesn't grow with queries times vectors."""
    monkeypatch.setattr(lo, "CELL_NUMBERS", 600)
    q, v = clustered
    laid = lo.lay_out(v.where("vec_id >= 1000"), list_rows=20)
    blocks = lo.packed(q, ["query_id"], (), "x")
    cells, routes = laid.rows.select("cell").distinct().count(), lo.routed(blocks, laid, lo.probing(lo.LISTS)).count()
    zones = 2 * q.sparkSession.sparkContext.defaultParallelism
    assert routes <= zones * blocks.count() and cells > 2 * zones
    plain = v.where("vec_id >= 1000").select("vec_id", "v")
    close(lo.regress(q, laid, 0.6, 0.05), k.kernel_regress(q, plain, 0.6, 0.05), ["query_id"], "x_hat")
    assert tuples(lo.nearest(q, laid, 5), "query_id", "rank", "vec_id", "d2") == tuples(k.knn_flat(q, plain, 5), "query_id", "rank", "vec_id", "d2")


def test_pairs_of_blocks_are_not_copied(clustered):
    """Neither side is repeated for each block of the other: no rows are generated, blocks meet where they lie."""
    q, v = clustered
    for df in (k.kernel_regress(q, v.select("vec_id", "v"), 0.6, 0.5, 100), k.knn_flat(q, v, 5, 100), k.knn_flat(q, v, 5, 100, on=("g",))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroups" not in plan


def test_weights_that_dont_count_fall_away(monkeypatch):
    r = np.random.default_rng(2)
    y = r.normal(size=(900, 12))
    x = 0.9 * y[:150] + 1e-3 * r.normal(size=(150, 12))
    x[3] = 50.0
    for sigma, scale in ((1e-3, 1), (0.3, 1), (4.0, 1), (1e-3, 1e18), (0.3, 1e-18)):
        a, b, s = x * scale, y * scale, sigma * scale
        logit = (2 * 0.9 * a @ b.T - 0.81 * (b * b).sum(1)[None, :]) / (2 * s * s)
        w = np.exp(logit - logit.max(1, keepdims=True))
        top, total, sums = k.weighed(a, b, 0.9, s)
        assert np.allclose(top, logit.max(1), rtol=1e-9) and np.allclose(sums / total[:, None], w @ b / w.sum(1)[:, None], rtol=1e-5, atol=1e-9 * scale)
        again = k.weighed(a, b, 0.9, s, top + 1000)[1]
        assert sigma > 0.1 or not np.delete(again, 3).any()  # the far one is within the error
