"""Order statistics, running sums and intervals against plain Python, with groups that are cut."""

import random

import pytest
from pyspark.sql import functions as F

from patchspark.operators import samplers as sm
from patchspark.operators import selection as se
from patchspark.plans import catalogue as c
from patchspark.sources import tables as s


def test_order_statistic_equals_sorting(spark):
    r = random.Random(4)
    groups = {"even": [r.random() for _ in range(700)], "one": [5.0], "same": [2.5] * 900, "outliers": [r.gauss(0, 1) for _ in range(500)] + [1e300, -1.7e308, 1.7e308, 1e-300],
              "hot": [float(int(r.expovariate(1e-3))) for _ in range(4000)], "steps": [2.0 ** -(i % 900) for i in range(1200)], "signs": [0.0, -0.0, -1.0, 1.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for q in (0.0, 0.37, 0.5, 1.0):
        got = {x["g"]: x["v"] for x in se.order_statistic(df, ["g"], "v", F.bround((F.col("n") - 1) * q), few=50).collect()}
        assert got == {g: sorted(vs)[round((len(vs) - 1) * q)] for g, vs in groups.items()}
    assert {x["g"] for x in se.order_statistic(df, ["g"], "v", F.lit(3), few=50).collect()} == set(groups) - {"one"}
    assert se.order_statistic(df.limit(0), ["g"], "v", F.lit(0)).count() == 0


def test_running_sums_of_a_run_that_is_cut(spark):
    r = random.Random(1)
    rows = [(i % 3 if i % 4 else 0, r.randrange(50), i, float(r.randrange(9))) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, t int, i int, a double")
    got = {x["i"]: x["before"] for x in se.running_sums(df, ["g"], ["t", "i"], "a", tasks=7).collect()}
    want = {i: sum(a2 for g2, t2, i2, a2 in rows if g2 == g and (t2, i2) < (t, i)) for g, t, i, _ in rows}
    assert got == want


def test_net_of_io_equals_all_pairs(spark):
    r = random.Random(2)
    stages = [(r.choice([1, 1, 1, 2]), i, float(r.randrange(40)), float(r.randrange(12))) for i in range(200)] + [(1, 900, None, 3.0), (3, 901, 1.0, 2.0)]
    io = [(r.choice([1, 1, 2, 4]), float(r.randrange(50)), r.randrange(8) / 4) for _ in range(300)]
    a = spark.createDataFrame(stages, "run_id int, seq int, start double, seconds double")
    b = spark.createDataFrame(io, "run_id int, start double, seconds double")
    want = {i: sec - sum(x for run2, t, x in io if start is not None and run2 == run and start <= t < start + sec) for run, i, start, sec in stages}
    assert {x["seq"]: x["net"] for x in c.net_of_io(a, b).collect()} == pytest.approx(want)
    plan = c.net_of_io(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan.split("Join")[0] and c.net_of_io(a.limit(0), b).count() == 0


def test_trace_is_replaced_and_a_run_goes_on_from_it(spark, tmp_path, monkeypatch):
    px = spark.createDataFrame([(i, 0, y, x, float((7 * x + 3 * y + i) % 5) / 2.5 - 1) for i in (1, 2) for y in range(6) for x in range(6)], "image_id int, c int, y int, x int, v double")
    make = lambda: sm.Process(spark, p=3, num_steps=1, least=3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    want = rows(sm.sample_uncond(make(), px, 2, trace=whole))
    prior, asked = sm.Process.prior, []

    def fails(self, px, scale=0, *more):
        asked.append(scale)
        if len(asked) == 2:
            raise RuntimeError("lost")
        return prior(self, px, scale, *more)

    monkeypatch.setattr(sm.Process, "prior", fails)
    with pytest.raises(RuntimeError):
        sm.sample_uncond(make(), px, 2, trace=cut)
    assert s.whole_scales(spark, cut) == {1}
    got = rows(sm.sample_uncond(make(), px, 2, trace=cut, resume=True))
    assert got == want and asked == [1, 0, 0]
    assert rows(s.read_table(spark, cut)) == rows(s.read_table(spark, whole)) and s.whole_scales(spark, cut) == {0, 1} and s.whole_scales(spark, str(tmp_path / "no")) == set()
    both = px.withColumn("scale", F.lit(0)).unionByName(px.withColumn("scale", F.lit(1)))
    for df in (both, both.where("scale = 1")):
        s.write_table(df, str(tmp_path / "table"))
    assert s.read_table(spark, str(tmp_path / "table")).count() == both.count()
