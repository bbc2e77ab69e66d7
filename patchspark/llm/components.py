"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchspark.llm.store import written


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return _pairs(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _pairs(moved.unionAll(low.select("a", F.col("low").alias("b"))))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of edges (a long, b long); component is the smallest id that is reachable.

    Alternates the large-star and small-star steps until the edges stay as they are; each round is two equi-joins
    and two aggregations over the edges, and is written to the shared folder. Only a count and a hash sum of the
    edges come to the driver. Edges with a null end and self-links are left out; no edges give an empty table.
    """
    now = written(_pairs(edges.where("a is not null and b is not null").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))), "edges")
    state = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = now.agg(*state).first()
    for _ in range(max_rounds if before[0] else 0):
        now = written(_small_star(_large_star(now)), "edges")
        after = now.agg(*state).first()
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        roots.select("id", F.col("id").alias("component")))
