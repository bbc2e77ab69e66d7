"""Order statistics by group and running sums over sorted events, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchspark.sources.steps import kept

#: Bins of a histogram, and values of a group that are put in order at once.
BINS, FEW = 4096, 10_000


def order_statistic(values: DataFrame, by: Sequence[str], value: str, rank: Column, few: int = FEW) -> DataFrame:
    """(by, value): the exact value at 0-based `rank`, a column of the number n of the group's values; null and NaN don't count.

    Successive histograms: the values between a group's bounds are counted by bin, and the bin that holds the rank gives
    new bounds, its own least and largest value, so that outliers fall away at once. What is left of a group, `few` at most,
    is put in order. Each pass counts in its tasks and sends a row a bin; a rank outside the group gives no row.
    """
    by, v = list(by), F.col("__v")
    rows = values.select(*by, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    state = kept(state.withColumn("r", rank.cast("long")).where((F.col("r") >= 0) & (F.col("r") < F.col("n"))))
    wide = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    while state.where(wide).limit(1).count():
        span = rows.join(state.where(wide), by).where(v.between(F.col("lo"), F.col("hi")))
        # halves, so that the width of any two doubles is finite
        place = F.floor((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        bins = span.withColumn("bin", F.least(place, F.lit(BINS - 1))).groupBy(*by, "r", "bin").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = bins.withColumn("before", before).where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
        state = kept(held.select(*by, "n", "lo", "hi", (F.col("r") - F.col("before")).alias("r")).unionByName(state.where(~wide)))
    one = F.col("lo") == F.col("hi")
    span = rows.join(state.where(~one), by).where(v.between(F.col("lo"), F.col("hi")))
    ordered = span.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(v)) - 1).where(F.col("__i") == F.col("r"))
    return ordered.select(*by, v.alias(value)).unionByName(state.where(one).select(*by, F.col("lo").alias(value)))


def running_sums(events: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, tasks: int | None = None) -> DataFrame:
    """events with `before`: the sum of `amount` of the group's events before each, by `order`.

    Events are dealt to tasks by ranges of (by, order), so a group of any size is cut; each task sums its own stretch of a
    group, and the sums of stretches, one row each, are added up. The ranges are written down, so that a task that is run
    again finds its stretch as it was.
    """
    by, order = list(by), list(order)
    tasks = tasks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(events.repartitionByRange(tasks, *by, *order).withColumn("__task", F.spark_partition_id()))
    upto = Window.unboundedPreceding, -1
    own = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "__task").orderBy(*order).rowsBetween(*upto)), F.lit(0.0))
    stretches = dealt.groupBy(*by, "__task").agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__task").rowsBetween(*upto)), F.lit(0.0))
    stretches = stretches.withColumn("__earlier", earlier).drop("__sum")
    return dealt.withColumn("__own", own).join(stretches, [*by, "__task"]).withColumn("before", F.col("__own") + F.col("__earlier")).drop("__own", "__earlier", "__task")
