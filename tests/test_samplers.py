"""The samplers on small images, against numpy or a property."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchspark.functions import geometry as g
from patchspark.operators import measures as m
from patchspark.operators import samplers as sm


@pytest.fixture(scope="module")
def px(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, c, y, x, float(rng.uniform(-1, 1))) for i in (1, 2) for c in range(2) for y in range(6) for x in range(7)],
                                 "image_id int, c int, y int, x int, v double")


def arrays(df):
    rows = df.collect()
    out = {i: np.zeros([1 + max(r[k] for r in rows if r["image_id"] == i) for k in ("c", "y", "x")]) for i in {r["image_id"] for r in rows}}
    for r in rows:
        out[r["image_id"]][r["c"], r["y"], r["x"]] = r["v"]
    return out


def test_denoise_against_numpy(spark, px, monkeypatch):
    monkeypatch.setattr(sm, "EXACT_ROWS", 3)  # several lists an image
    got = arrays(sm.denoise(px, sm.Process(spark, p=3).prior(px), sm._same(px), 3, 0.7, 0.5))
    for i, a in arrays(px).items():
        places = [(y, x) for y in range(4) for x in range(5)]
        v = np.array([a[:, y : y + 3, x : x + 3].ravel() for y, x in places])
        logit = -((v[:, None] - 0.7 * v[None]) ** 2).sum(2) / 0.5
        w = np.exp(logit - logit.max(1, keepdims=True))
        hat, total, n = w @ v / w.sum(1, keepdims=True), np.zeros_like(a), np.zeros_like(a)
        for (y, x), h in zip(places, hat, strict=True):
            total[:, y : y + 3, x : x + 3] += h.reshape(2, 3, 3)
            n[:, y : y + 3, x : x + 3] += 1
        assert np.allclose(got[i], total / n)


def test_symmetric_and_repeatable(spark, px):
    p = sm.Process(spark, p=3, num_steps=2, eta=1.0, seed=5)
    one = sm.sample_symmetric(p, px, 1)
    assert {r["asymmetry"] for r in m.mirror_asymmetry(one).collect()} == {0.0}
    again = arrays(sm.sample_symmetric(p, px.repartition(3), 1))
    assert all(np.allclose(again[i], a) for i, a in arrays(one).items())


def test_retarget_has_the_size_asked_for(spark, px):
    to = spark.createDataFrame([(1, 8, 10), (2, 7, 7)], "image_id int, height int, width int")
    out = arrays(sm.sample_retarget(sm.Process(spark, p=3, num_steps=2), px, 2, to))
    assert {i: a.shape for i, a in out.items()} == {1: (2, 8, 10), 2: (2, 7, 7)}


def test_inversion_of_little_noise_comes_back_and_no_gradient_changes_nothing(spark, px):
    p, priors = sm.Process(spark, p=3, num_steps=3), sm._same(px)
    prior = p.prior(px)
    back = arrays(sm.reconstruct(p, sm.invert(p, px, prior, priors, 0.0), prior, priors, 0.0))
    assert all(np.allclose(back[i], a, atol=1e-2) for i, a in arrays(px).items())
    free = arrays(sm.guided_reconstruct(p, px, lambda now: now.withColumn("v", F.lit(0.0)), 1.0, 0.0, momentum=1.0))
    assert all(np.allclose(free[i], np.clip(a, -1, 1)) for i, a in back.items())


def test_tileable_and_analogy(spark, px):
    p = sm.Process(spark, p=3, num_steps=1)
    assert sm.sample_tileable(p, px, 1, "both").count() == px.count()
    with pytest.raises(ValueError):
        sm.sample_tileable(p, px, 1, "up")
    pairs = spark.createDataFrame([(9, 1, 2)], "image_id int, style_id int, structure_id int")
    out = arrays(sm.sample_analogy(p, px, pairs, 1))
    assert set(out) == {9} and out[9].shape == (2, 6, 7) and g.sizes(px).count() == 2


def test_a_style_of_many_pairs_is_laid_out_once(spark, px, monkeypatch):
    laid, real = [], sm.lo.lay_out_blocks
    monkeypatch.setattr(sm.lo, "lay_out_blocks", lambda blocks, *more, **named: laid.append(blocks.agg(F.sum("n")).first()[0]) or real(blocks, *more, **named))
    pairs = spark.createDataFrame([(i, 1, 2) for i in (7, 8, 9)], "image_id int, style_id int, structure_id int")
    out = arrays(sm.sample_analogy(sm.Process(spark, p=3, num_steps=2), px, pairs, 1))
    assert set(out) == {7, 8, 9} and laid == [20, 20]  # the windows of one structure and of one style


def test_neighbours_in_the_sampler(spark, px):
    """At little noise the nearest patch decides, so few neighbours and lists give what all patches give."""
    exact, lists = sm.Process(spark, p=3), sm.Process(spark, p=3, backend="auto", switch=10)
    one = arrays(sm.denoise(px, exact.prior(px), sm._same(px), 3, 0.999, 0.01))
    two = arrays(sm.denoise(px, lists.prior(px), sm._same(px), 3, 0.999, 0.01, neighbours=2, nprobe=4))
    assert all(np.allclose(one[i], two[i], atol=1e-6) for i in one)
    assert lists.prior(px).searched is not None and sm.Process(spark, p=3, backend="auto").prior(px).searched is None
    flat = arrays(sm.denoise(px, lists.prior(px), sm._same(px), 3, 0.0, 1.0))
    want = arrays(sm.denoise(px, exact.prior(px), sm._same(px), 3, 0.0, 1.0))
    assert all(np.allclose(flat[i], want[i]) for i in want)
    with pytest.raises(ValueError, match="fewer than"):
        sm.denoise(px, lists.prior(px), sm._same(px), 3, 0.9, 0.1, neighbours=99)
    with pytest.raises(ValueError):
        sm.Process(spark, p=3, backend="none").prior(px)


def test_sample_is_a_run_with_its_seed(spark, px):
    plan = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 5)], "image_id int, sample_id int, seed int")
    make = lambda seed: sm.Process(spark, p=3, num_steps=4, eta=0.5, seed=seed)
    out, alone = arrays(sm.sample_uncond(make(0), px, 1, plan)), arrays(sm.sample_uncond(make(6), px, 1))
    assert set(out) == {"1_000", "1_001", "2_000"} and np.allclose(out["1_001"], alone[1]) and not np.allclose(out["1_000"], alone[1])


def test_settings_by_scale(spark, px, tmp_path):
    p = sm.Process(spark, p=3, num_steps=[2, 1], stride=[2, 1], rho=[0.2, 0.5], backend=["auto", "exact"], least=3)
    assert sm.sample_uncond(p, px, 2, trace=str(tmp_path / "t")).count() == px.count()
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("scale").count().count() == 2
    with pytest.raises(ValueError):
        sm.sample_uncond(p, px, 3)


def test_warped_schedule_in_a_sampler(spark, px):
    out = arrays(sm.sample_uncond(sm.Process(spark, p=3, num_steps=3, schedule="ve"), px, 1))
    assert all(np.isfinite(a).all() and np.abs(a).max() <= 1 + 1e-9 for a in out.values())


def test_pixels_are_not_broadcast(spark, px, monkeypatch):
    """However small their files: a flat estimate is a few bytes and as many rows as any."""
    monkeypatch.setattr(sm, "kept", lambda df: df)
    p, priors = sm.Process(spark, p=3, num_steps=3), sm._same(px)
    moved = p.moved(px.select(*sm.KEYS, "v"), px, px, priors, 2, 1, 0, 0.0)
    for df in (moved, sm.drawn_to(px, px)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_flat_pixels_beside_their_sizes(spark, px, tmp_path):
    """The row of an image is what is broadcast, though the file of flat pixels is the smaller one."""
    px.select("image_id", "c", "y", "x", F.lit(0.5).alias("v")).coalesce(1).write.parquet(str(tmp_path / "flat"))
    flat = spark.read.parquet(str(tmp_path / "flat"))
    sizes = spark.createDataFrame([(i, 3, 4) for i in range(5000)], "image_id int, height int, width int")
    plan = g.of_image(flat, sizes)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
