"""Noise schedules and the arithmetic of one step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flow_linear(spark, num_steps: int = 10, sigma_min: float = 1e-4) -> DataFrame:
    """(t, alpha, sigma): t = 0 is (1, 0); from 1 to num_steps alpha falls from 1 - sigma_min to 0 and sigma = 1 - alpha."""
    t = F.col("id")
    alpha = (1 - sigma_min) * (1 - (t - 1) / max(1, num_steps - 1)) if num_steps > 1 else F.lit(1 - sigma_min)
    alpha = F.when(t == 0, 1.0).otherwise(alpha)
    return spark.range(num_steps + 1).select(t.cast("int").alias("t"), alpha.alias("alpha"), (1 - alpha).alias("sigma"))


def ve_edm(spark, num_steps: int = 10, sigma_min: float = 0.002, sigma_max: float = 80.0, rho: float = 7.0) -> DataFrame:
    """(t, alpha, sigma) with alpha 1 and sigma warped by rho, rising with t; at least two steps."""
    if num_steps < 2:
        raise ValueError("the warped schedule needs two steps or more")
    low, high = sigma_min ** (1 / rho), sigma_max ** (1 / rho)
    at = F.lit(num_steps) - F.col("id")
    sigma = F.pow(F.lit(high) + at / (num_steps - 1) * (low - high), F.lit(rho))
    return spark.range(num_steps + 1).select(F.col("id").cast("int").alias("t"), F.lit(1.0).alias("alpha"), F.when(F.col("id") == 0, 0.0).otherwise(sigma).alias("sigma"))


def noise_fraction(alpha: Column, sigma: Column) -> Column:
    return sigma / (alpha + sigma)


def index_for_noise_level(levels: DataFrame, schedule: DataFrame) -> DataFrame:
    """(level, t): the step whose noise fraction is nearest, the smaller of two; never 0; the last for a null level."""
    steps = schedule.agg(F.sort_array(F.collect_list(F.struct("t", noise_fraction(F.col("alpha"), F.col("sigma")).alias("f")))).alias("steps"))
    near = F.array_min(F.transform("steps", lambda s: F.struct(F.abs(s["f"] - F.col("level")).alias("d"), s["t"].alias("t"))))["t"]
    last = F.element_at("steps", -1)["t"]
    return levels.crossJoin(F.broadcast(steps)).select("level", F.greatest(F.coalesce(F.when(F.col("level").isNotNull(), near), last), F.lit(1)).alias("t"))


def keyed_uniform(*keys: Column) -> Column:
    """In (0, 1), 52 bits of the MD5 sum of the keys alone: no partitioning changes it, and any engine can form it."""
    digits = F.substring(F.md5(F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def keyed_normal(*keys: Column) -> Column:
    """Standard normal from the keys, by Box and Muller."""
    return F.sqrt(-2 * F.log(keyed_uniform(F.lit(1), *keys))) * F.cos(2 * math.pi * keyed_uniform(F.lit(2), *keys))


def add_noise(x: Column, eps: Column, alpha: Column, sigma: Column) -> Column:
    return alpha * x + sigma * eps


def epsilon(xt: Column, x_hat: Column, alpha: Column, sigma: Column) -> Column:
    """(x_t - alpha x_hat) / sigma; an error at the terminal step."""
    return F.when(sigma > 0, (xt - alpha * x_hat) / sigma).otherwise(F.raise_error(F.lit("no noise at the terminal step")).cast("double"))


def step(x_hat: Column, eps: Column, alpha: Column, sigma: Column, eta: float = 0.0, fresh: Column | None = None) -> Column:
    """To a step with (alpha, sigma); sigma 0 gives x_hat."""
    if not 0 <= eta <= 1:
        raise ValueError("eta lies in [0, 1]")
    moved = alpha * x_hat + sigma * math.sqrt(1 - eta * eta) * eps
    return F.when(sigma == 0, x_hat).otherwise(moved + eta * sigma * fresh if eta else moved)
