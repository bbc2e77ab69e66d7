"""Exact k largest inner products by buckets of similar length.

Vectors are grouped by length, longest first, into buckets of a bounded size. The first buckets give each query k products,
whose least is a bound: no product |q| |p| cos can pass it in buckets whose longest vector is too short, so a query goes to
a prefix of the buckets only. Inside a bucket the bound divided by both lengths is a local threshold of the cosine. Where
it is high, an entry of the unit vectors must lie in a narrow range about the query's own (the angle to a coordinate axis
differs by no more than the angle between the two), and the narrowest of the query's largest coordinates gives the
candidates; where it is low, the bucket's rows that are long enough do. Products of candidates are taken exactly.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchspark.llm.store import written

#: Numbers in a bucket, rows of a block of queries, and buckets that give the first bound.
BUCKET_NUMBERS, BLOCK_ROWS, FIRST = 1 << 20, 4096, 1
#: Classes of length in a doubling; a double has at most 1100 doublings from 1 up.
CLASSES = 64
#: Local thresholds from which coordinates are tried, coordinates tried, and the share of a bucket that they may leave.
STEEP, FOCUS, SHARE = 0.75, 3, 1 / 16
#: Products are taken for so many queries at once. Bounds are widened by so much against rounding.
AT_ONCE, WIDER = 256, 1 + 1e-9
#: Rows of a table that is broadcast; a longer one is joined by a shuffle.
SMALL = 100_000
LARGEST = 1.7e308


def _sent(df: DataFrame) -> DataFrame:
    """df, broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers held as doubles, as 64-bit integers (held at the ends of their range)."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if np.abs(q).max() * np.abs(p).max() * q.shape[1] < 2.0**53:
        return (q @ p.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in p], object).reshape(p.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _unit(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return x / np.where(size > 0, size, 1)[:, None]


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: np.ndarray):
        order = np.lexsort((ids, -size))
        self.ids, self.rows, self.size = ids[order], rows[order], size[order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self.axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long_enough(self, size: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many rows, from the longest on, can have a product of at least `least` with a query of that size."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(least <= 0, -1.0, np.where(size > 0, least / (size * WIDER), np.inf))
        return np.searchsorted(-self.size, -need, "right")

    def own(self, id_: int, row: np.ndarray) -> int:
        """The place of one copy of the query itself, or -1."""
        a, b = np.searchsorted(self.sorted_ids, [id_, id_], "left")[0], np.searchsorted(self.sorted_ids, id_, "right")
        for at in self.by_id[a:b]:
            if np.array_equal(self.rows[at], row):
                return int(at)
        return -1

    def _axis(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.axes:
            x = _unit(self.rows, self.size)[:, f]
            order = np.argsort(x)
            self.axes[f] = order, x[order]
        return self.axes[f]

    def near_axes(self, unit: np.ndarray, cosine: float, most: int) -> np.ndarray | None:
        """Places of all rows whose cosine with the unit query can reach `cosine`, if a coordinate leaves at most `most`."""
        angle, best = np.arccos(min(1.0, cosine / WIDER)) + 1e-7, None
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            order, x = self._axis(f)
            own = np.arccos(np.clip(unit[f], -1, 1))
            low = np.searchsorted(x, np.cos(min(np.pi, own + angle)) - 1e-9, "left")
            high = np.searchsorted(x, np.cos(max(0.0, own - angle)) + 1e-9, "right")
            if best is None or high - low < len(best):
                best = order[low:high]
        return best if best is not None and len(best) <= most else None

    def best(self, ids: np.ndarray, rows: np.ndarray, size: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, product) of the k largest products of each query that are at least `least`, its own row left out."""
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        upto, unit = self.long_enough(size, least), _unit(rows, size)
        longest = self.size[0] if len(self.size) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((least > 0) & (size * longest > 0), least / (size * longest), -1.0)
        scanned = []
        for i in np.flatnonzero(upto):
            near = self.near_axes(unit[i], cosine[i], int(SHARE * upto[i])) if cosine[i] >= STEEP else None
            if near is None:
                scanned.append(i)
            else:
                near = near[near < upto[i]]
                out.append((i, near, _products(rows[i : i + 1], self.rows[near])[0]))
        found = [self._first(i, near, products, ids[i], rows[i], least[i], k) for i, near, products in out]
        scanned = np.array(sorted(scanned, key=upto.__getitem__), np.int64)
        for cut in range(0, len(scanned), AT_ONCE):
            some = scanned[cut : cut + AT_ONCE]
            n = int(upto[some].max())
            for i, products in zip(some.tolist(), _products(rows[some], self.rows[:n]), strict=True):
                found.append(self._first(i, None, products, ids[i], rows[i], least[i], k))
        found = [f for f in found if len(f[1])]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])

    def _first(self, i: int, near: np.ndarray | None, products: np.ndarray, id_: int, row: np.ndarray, least: float, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        own = self.own(id_, row)
        # k + 1 with the query itself; what ties with the last of them is looked at too
        if len(products) > k + 1:
            least = max(least, float(np.partition(products, len(products) - k - 1)[len(products) - k - 1]))
        at = np.flatnonzero(products.astype(float) >= least / WIDER if least > 0 else products.astype(float) >= least * WIDER)
        place = at if near is None else near[at]
        keep = place != own
        place, products = place[keep], products[at][keep]
        order = np.lexsort((self.ids[place], -products))[:k]
        return i, place[order], products[order]


def _met(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(query, id, key, times, vec_id, score) of the k best of each query in each bucket that its block meets.

    blocks: (dim, block, from_bucket, to_bucket, data); buckets: (dim, bucket, blocks, data): how many blocks it meets.
    """
    def search(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "key", "times", "vec_id", "score"]
        if not len(q) or not len(b):
            return pd.DataFrame(columns=names, dtype="int64")
        ids, keys, times, least, rows, size = pickle.loads(q["data"].iloc[0])
        bucket = Bucket(*pickle.loads(b["data"].iloc[0]))
        of, place, products = bucket.best(ids, rows.astype(float), size, least, k)
        return pd.DataFrame(dict(zip(names, (ids[of], keys[of], times[of], bucket.ids[place], products), strict=True)))

    q = blocks.where("from_bucket <= to_bucket").withColumn("bucket", F.explode(F.sequence("from_bucket", "to_bucket"))).select("dim", "bucket", "block", "data")
    b = buckets.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("dim", "bucket", "block", "data")
    on = ["dim", "bucket", "block"]
    return q.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(search, "query_id long, key long, times long, vec_id long, score long")


def _rows_of(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([np.asarray(v, float) for v in part["v"]]).reshape(len(part), -1)
    return (rows.astype(np.int16) if rows.size and np.abs(rows).max() < 2**15 else rows), part["size"].to_numpy()


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
                 bucket_numbers: int = BUCKET_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all rows but its own.

    Entries become floor(scale * x), x as double; is_query is a condition on the column vec_id. Ties go to the smaller
    vec_id. Defined cases: vectors that are null or hold null or non-finite numbers take no part; vectors of different
    lengths are not compared; a zero vector's products are 0; fewer than k other rows give all; rows that share a vec_id
    are rows of their own (a repeated query is answered as often as it comes, with its copies as candidates); rows without
    an id take part as candidates, after all others among equals, with a null vec_id; products beyond 64 bits are held at
    their ends; no rows give no rows; columns that are not named are not read.
    """
    x = F.col("v")
    valid = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    scaled = lambda e: F.greatest(F.least(e * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    whole = F.transform(x, lambda e: F.when(F.abs(scaled(e)) < 2.0**53, F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(valid)
    high = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    size = F.least(high * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + (e / F.col("high")) * (e / F.col("high")))), F.lit(LARGEST))
    nodes = rows.withColumn("v", whole).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("high", high)
    nodes = nodes.withColumn("size", F.when(F.col("high") > 0, size).otherwise(0.0)).drop("high").withColumn("dim", F.size("v"))
    kind = F.when(F.col("size") > 0, F.floor(F.log2("size") * CLASSES)).otherwise(-1).cast("int")
    nodes = written(nodes.withColumn("kind", kind).withColumn("key", F.xxhash64("id", "v")), "vectors")

    # Classes of length in groups of about a bucket's rows, longest first; a larger group has several buckets.
    a_bucket = F.greatest(F.lit(bucket_numbers) / F.greatest(F.col("dim"), F.lit(1)), F.lit(64.0))
    longest_first = Window.partitionBy("dim").orderBy(F.desc("kind"))
    kinds = nodes.groupBy("dim", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest"))
    kinds = kinds.withColumn("group", F.floor((F.sum("n").over(longest_first) - F.col("n")) / a_bucket))
    groups = kinds.groupBy("dim", "group").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).withColumn("buckets", F.ceil(F.col("n") / a_bucket))
    groups = written(groups.withColumn("first", F.sum("buckets").over(Window.partitionBy("dim").orderBy("group")) - F.col("buckets")), "length-groups")
    place = kinds.select("dim", "kind", "group").join(groups.select("dim", "group", "buckets", "first"), ["dim", "group"])

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.loc[part.index.repeat(np.minimum(part["times"], k + 1))]
        matrix, sizes = _rows_of(part)
        return pd.DataFrame({"dim": [key[0]], "bucket": [key[1]], "group": [key[2]], "data": [pickle.dumps((part["id"].to_numpy(), matrix, sizes), 5)]})

    placed = nodes.join(_sent(place), ["dim", "kind"]).withColumn("bucket", F.col("first") + F.pmod(F.xxhash64("key", F.lit(1)), "buckets"))
    buckets = written(placed.groupBy("dim", "bucket", "group").applyInPandas(packed, "dim int, bucket long, group long, data binary"), "buckets")
    # By vector length: the longest vector of each group and its last bucket, longest group first; few rows, as length classes are few.
    ladder = groups.groupBy("dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("group", "longest", F.col("first") + F.col("buckets") - 1))),
                                                   lambda g: F.struct(g["longest"].alias("longest"), g["col3"].alias("last"))).alias("steps"))

    def blocked(asked: DataFrame, from_bucket: int) -> tuple[DataFrame, DataFrame]:
        """Queries (with least and step, the last group they reach) in blocks of one step; buckets with the number of blocks that come."""
        many = asked.groupBy("dim", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.ceil(F.col("n") / BLOCK_ROWS))
        many = written(many.withColumn("upto", F.sum("own").over(Window.partitionBy("dim").orderBy(F.desc("step")))), "query-steps")
        ends = groups.select("dim", F.col("group").alias("g"), (F.col("first") + F.col("buckets") - 1).alias("last"))
        rank = F.row_number().over(Window.partitionBy("dim").orderBy("g")) - 1
        ends = ends.withColumn("step", rank)
        dealt = asked.join(_sent(many.join(ends, ["dim", "step"]).select("dim", "step", "own", "upto", "last")), ["dim", "step"])
        dealt = dealt.withColumn("block", F.col("upto") - F.col("own") + F.pmod(F.xxhash64("key", F.lit(2)), "own"))

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            matrix, sizes = _rows_of(part)
            data = pickle.dumps((part["id"].to_numpy(), part["key"].to_numpy(), part["times"].to_numpy(), part["least"].to_numpy(), matrix, sizes), 5)
            return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "to_bucket": [key[2]], "data": [data]})

        blocks = dealt.groupBy("dim", "block", "last").applyInPandas(pack, "dim int, block long, to_bucket long, data binary")
        steps = many.select("dim", "step", "upto")
        come = ends.select("dim", "g", "step").join(steps.withColumnRenamed("step", "reached"), "dim").where("reached >= step").groupBy("dim", "g").agg(F.max("upto").alias("blocks"))
        meeting = buckets.where(F.col("bucket") >= from_bucket).join(_sent(come.withColumnRenamed("g", "group")), ["dim", "group"]).select("dim", "bucket", "blocks", "data")
        return blocks.withColumn("from_bucket", F.lit(from_bucket).cast("long")), meeting

    queries = nodes.where((F.col("id") < 2**63 - 1) & F.coalesce(is_query, F.lit(False))) if "id" == id_col else nodes.withColumn(id_col, F.nullif("id", F.lit(2**63 - 1))).where(
        F.coalesce(is_query, F.lit(False))).drop(id_col)
    last_first = F.lit(FIRST - 1).cast("long")
    start, meeting = blocked(queries.withColumns({"least": F.lit(float("-inf")), "step": F.lit(0)}), 0)
    start = start.withColumn("to_bucket", F.least(F.col("to_bucket"), last_first))
    first = written(_met(start, meeting.where(F.col("bucket") < FIRST), k), "first-products")
    bound = first.groupBy("query_id", "key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
    asked = queries.join(bound.withColumnRenamed("query_id", "id"), ["id", "key"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    reach = F.size(F.filter("steps", lambda s: (s["longest"] * F.col("size") * WIDER >= F.col("least")))) - 1
    asked = written(asked.join(_sent(ladder), "dim").withColumn("step", reach).drop("steps"), "queries")
    rest = _met(*blocked(asked, FIRST), k)
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return copies.select("query_id", "rank", F.nullif("vec_id", F.lit(2**63 - 1)).alias("vec_id"), "score")


def op13_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH rows AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
    FROM rows q JOIN rows p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
