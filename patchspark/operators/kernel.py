"""Kernel regression and nearest neighbours over tables of vectors.

Pairs are never listed, and neither side is copied: a task holds a few blocks of queries and reads blocks of vectors one
after the other from where they were written, and gives per query the partial softmax (largest logit, sum of weights,
weighted sum) or the best k; partials of a query are merged afterwards. `keys` name a query, `on` names columns that query
and vector must share: by default there are none, and every query meets every vector.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchspark.sources.steps import kept

#: Rows of a block of queries and of vectors, and of one that travels; bytes of vectors that a task reads.
BLOCK, PACKED, READ = 4096, 512, 256 << 20
QUERY = ("query_id",)
#: Queries that meet a block of vectors at once; the error of a product in single precision, for each term.
AT_ONCE, ROUGH = 64, 1.2e-7
#: How far below the largest logit weights don't count (1e-20 of it), and the share of weights that count from which all are taken.
GAP, DENSE = 46.0, 0.02
#: The share of rows that queries want below which distances are taken pair by pair.
SPARSE = 0.1


def fields(df: DataFrame, names: Iterable[str], *more: tuple[str, str]) -> T.StructType:
    """The columns of df by name, then (name, type) pairs, as a schema."""
    out = T.StructType([df.schema[n] for n in names])
    for name, kind in more:
        out = out.add(T.StructType.fromDDL(f"{name} {kind}")[0])
    return out


def matrix(column: Iterable) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column])


def packed(rows: DataFrame, keys: Sequence[str], on: Sequence[str], column: str, block: int = PACKED) -> DataFrame:
    """(on, id, n, data): rows in blocks of about `block`, each with its keys and the matrix of `column`; what is in a block depends on keys alone."""
    counts = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).alias("__n"))
    sized = rows.join(counts, list(on)) if on else rows.crossJoin(F.broadcast(counts))
    dealt = sized.withColumn("__block", F.pmod(F.xxhash64(*keys), "__n")).withColumn("id", F.xxhash64(*on, "__block"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(keys))
        data = pickle.dumps(({k: part[k].to_numpy() for k in keys}, matrix(part[column])), 5)
        return pd.DataFrame({**{c: part[c].iloc[:1] for c in on}, "id": part["id"].iloc[:1], "n": [len(part)], "data": [data]})

    names = list(dict.fromkeys([*on, *keys, column, "id"]))
    return dealt.groupBy(*on, "__block").applyInPandas(lambda part: pack(part[names]), fields(rows, on, ("id", "long"), ("n", "long"), ("data", "binary")))


def met(queries: DataFrame, vectors: DataFrame, keys: Sequence[str], on: Sequence[str], rows: int) -> DataFrame:
    """(on, id, data, rows): packed blocks of queries (keys, x) beside packed blocks of vectors (vec_id, v).

    A task has a block of queries and READ bytes of vectors, which it reads where they lie, so what is written grows with
    either side and not with their product; all blocks of vectors of a task come for its block of queries in one go.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    q = kept(packed(queries, keys, on, "x", rows).select(*on, "id", "data"))
    v = kept(packed(vectors, ["vec_id"], on, "v", rows).select(*on, "id", F.col("data").alias("rows")))
    many, size = (max(1, df.count()) for df in (q, v))
    read = v.agg(F.sum(F.length("rows"))).first()[0] or 0
    parts = min(size, max(-(-read // READ), -(-2 * cores // many)))
    v = v.repartitionByRange(parts, "id").drop("id").hint("shuffle_replicate_nl")
    q = q.repartitionByRange(many, "id")
    return (v.join(q, list(on)) if on else v.crossJoin(q)).select(*on, "id", "data", "rows")


def dealt(queries: DataFrame, vectors: DataFrame, keys: Sequence[str], on: Sequence[str] = (), rows: int = BLOCK):
    """Both sides, cogrouped by pairs of blocks: within a group of `on` each query meets each vector in one place.

    A group of any size has as many blocks as it needs, so no task holds a whole group.
    """
    blocks = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
    many_q, many_v = blocks(queries, "__nq"), blocks(vectors, "__nv")
    counts = many_q.join(many_v, list(on)) if on else many_q.crossJoin(many_v).where("__nq > 0 and __nv > 0")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c, *of: F.pmod(F.xxhash64(*of), F.col(c))
    sized = lambda df: df.join(counts, list(on)) if on else df.crossJoin(F.broadcast(counts))
    q = sized(queries).withColumn("qb", own("__nq", *keys)).withColumn("vb", every("__nv")).drop("__nq", "__nv")
    v = sized(vectors).withColumn("vb", own("__nv", "vec_id")).withColumn("qb", every("__nq")).drop("__nq", "__nv")
    group = [*on, "qb", "vb"]
    return q.groupBy(*group).cogroup(v.groupBy(*group))


def merged(parts: DataFrame, keys: Sequence[str], name: str = "x_hat") -> DataFrame:
    """(keys, name): partial softmaxes (keys, top, total, sums) of a query made one mean. One shuffle by keys; rows stream."""
    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = np.ones(len(frame), bool)
            new[1:] = np.any([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys], axis=0)
            begins = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            top = np.maximum.reduceat(frame["top"].to_numpy(), begins)
            w = np.exp(frame["top"].to_numpy() - top[of])
            one = frame.iloc[begins][list(keys)].reset_index(drop=True)
            one["top"], one["total"] = top, np.add.reduceat(w * frame["total"].to_numpy(), begins)
            one["sums"] = list(np.add.reduceat(w[:, None] * np.stack(frame["sums"]), begins, axis=0))
            held = one.iloc[-1:]
            if len(one) > 1:
                yield done(one.iloc[:-1])
        if held is not None:
            yield done(held)

    def done(one: pd.DataFrame) -> pd.DataFrame:
        out = one[list(keys)].copy()
        out[name] = [s / t for s, t in zip(one["sums"], one["total"], strict=True)]
        return out

    sorted_parts = parts.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_parts.mapInPandas(joined, fields(parts, keys, (name, "array<double>")))


def rough_type(x: np.ndarray, y: np.ndarray) -> type:
    """Single precision where it holds the products."""
    return np.float32 if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e15 else np.float64


def weighed(x: np.ndarray, y: np.ndarray, alpha: float, sigma: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest logit, sum of weights, weighted sum) of each query over the rows of y; a sum of 0 if no row counts.

    least: logits that queries have reached elsewhere. Where few weights count, products in single precision, with their
    error, tell which; these are then taken in double precision, like all weights where many count.
    """
    top, total, sums = np.full(len(x), -np.inf), np.zeros(len(x)), np.zeros(x.shape)
    c, size = alpha / (sigma * sigma), alpha / 2 * (y * y).sum(1)
    with_size, with_one = np.hstack([y, -size[:, None]]), np.hstack([y, np.ones((len(y), 1))])
    kind = rough_type(x, y)
    x4, y4, size4, far = x.astype(kind), y.astype(kind), size.astype(kind), np.sqrt((y * y).sum(1).max(initial=0))
    sparse = c > 0
    for cut in range(0, len(x), AT_ONCE):
        some = slice(cut, cut + AT_ONCE)
        if sparse:
            rough = x4[some] @ y4.T
            rough -= size4
            slack = ROUGH * (x.shape[1] + 4) * (np.sqrt((x[some] * x[some]).sum(1)) + alpha / 2 * far) * far
            reached = rough.max(1) - slack if least is None else np.maximum(rough.max(1) - slack, least[some] / c)
            limit = reached - slack - GAP / c
            counts = rough >= np.nextafter(limit.astype(kind), kind(-np.inf))[:, None]
            sparse = np.isfinite(limit).all() and np.count_nonzero(counts) < DENSE * counts.size
        if not sparse:
            logit = np.hstack([x[some], np.ones((len(x[some]), 1))]) * c @ with_size.T
            top[some] = logit.max(1)
            logit -= top[some, None]
            both = np.exp(logit, out=logit) @ with_one
            sums[some], total[some] = both[:, :-1], both[:, -1]
            continue
        q, at = np.nonzero(counts)
        if not len(q):
            continue
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        near = y[at]
        logit = c * ((x[some][q] * near).sum(1) - size[at])
        own = cut + q[begins]
        top[own] = np.maximum.reduceat(logit, begins)
        w = np.exp(logit - top[cut + q])
        total[own], sums[own] = np.add.reduceat(w, begins), np.add.reduceat(w[:, None] * near, begins, axis=0)
    return top, total, sums


def add(part: tuple, at: np.ndarray, top: np.ndarray, total: np.ndarray, sums: np.ndarray) -> None:
    """Partial softmaxes of the rows `at` added to those of a block."""
    some = np.flatnonzero(total != 0)
    at, top, total, sums = at[some], top[some], total[some], sums[some]
    _, tops, totals, all_sums = part
    new = np.maximum(tops[at], top)
    old, own = np.exp(tops[at] - new), np.exp(top - new)
    tops[at] = new
    totals[at] = old * totals[at] + own * total
    all_sums[at] = old[:, None] * all_sums[at] + own[:, None] * sums


def kernel_regress(queries: DataFrame, vectors: DataFrame, alpha: float, sigma: float, rows: int = BLOCK,
                   keys: Sequence[str] = QUERY, on: Sequence[str] = ()) -> DataFrame:
    """(keys, x_hat) of queries (keys, x) over vectors (vec_id, v).

    x_hat is the mean of the v weighed by exp(-|x - alpha v|^2 / (2 sigma^2)): distances to the scaled vectors, mean of
    the raw ones. In double precision, with the largest logit taken off before the exponential.
    """
    if sigma <= 0:
        raise ValueError("sigma must be above 0")
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                own, x = pickle.loads(row.data)
                y = pickle.loads(row.rows)[1]
                _, top, total, sums = held.setdefault(row.id, (own, np.full(len(x), -np.inf), np.zeros(len(x)), np.zeros(x.shape)))
                add((own, top, total, sums), np.arange(len(x)), *weighed(x, y, alpha, sigma, top))
        for own, top, total, sums in held.values():
            yield pd.DataFrame({**own, "top": top, "total": total, "sums": list(sums)})[[*keys, "top", "total", "sums"]]

    q = queries.select(*dict.fromkeys([*keys, *on, "x"]))
    pairs = met(q, vectors.select(*on, "vec_id", "v"), keys, on, rows)
    return merged(pairs.mapInPandas(partial, fields(q, keys, ("top", "double"), ("total", "double"), ("sums", "array<double>"))), keys)


def knn_flat(queries: DataFrame, vectors: DataFrame, k: int, rows: int = BLOCK, keys: Sequence[str] = QUERY, on: Sequence[str] = ()) -> DataFrame:
    """(keys, rank, vec_id, d2): the k nearest vectors, ties by vec_id; fewer if there are fewer."""
    q, v = queries.select(*dict.fromkeys([*keys, *on, "x"])), vectors.select(*on, "vec_id", "v")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                (own, x), (of, y) = pickle.loads(row.data), pickle.loads(row.rows)
                part = held.setdefault(row.id, [own, np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)])
                i, at, rank, d2 = k_best(x, y, of["vec_id"], np.ones((len(x), 1), bool), np.zeros(len(y), np.int64), k, part[1][:, k - 1])
                better(part, np.arange(len(x)), k, (i, rank), d2, of["vec_id"][at])
        for own, d2, ids in held.values():
            i, rank = np.nonzero(np.isfinite(d2))
            yield pd.DataFrame({**{c: own[c][i] for c in keys}, "vec_id": ids[i, rank], "d2": d2[i, rank]})

    found = met(q, v, keys, on, rows).mapInPandas(partial, fields(queries, keys, ("vec_id", "long"), ("d2", "double")))
    return ranked(found, k, keys)


def better(part: list, at: np.ndarray, k: int, found: tuple, d2: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
    """part (own, d2, ids, more) of the queries `at` with what was found for them at (query, rank): the k nearest, ties by id."""
    some = np.unique(found[0])
    q, at = np.searchsorted(some, found[0]), at[some]
    for place, new in enumerate((d2, ids, *more), 1):
        fresh = np.full((len(at), k, *new.shape[1:]), np.inf if place == 1 else 0, part[place].dtype)
        fresh[q, found[1]] = new
        both = np.concatenate([part[place][at], fresh], axis=1)
        if place == 1:
            order = np.lexsort((np.hstack([part[2][at], _by_rank(len(at), k, q, found[1], ids)]), both), axis=1)[:, :k]
        part[place][at] = np.take_along_axis(both, order.reshape(*order.shape, *[1] * (both.ndim - 2)), 1)


def _by_rank(n: int, k: int, q: np.ndarray, rank: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((n, k), values.dtype)
    out[q, rank] = values
    return out


def k_best(x: np.ndarray, y: np.ndarray, ids: np.ndarray, need: np.ndarray, of: np.ndarray, k: int,
           reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, rank, squared distance) of the k nearest wanted rows of each query, ties by id; rows further than its reach needn't be told.

    need tells which query needs which list, of the list of each row. Rows that are too far fall away by products in single
    precision, with their error; what is left is measured in double precision.
    """
    q, at, size, many = [], [], (y * y).sum(1), min(k, len(y))
    whole = need.all()
    far = math.sqrt(size.max(initial=0))
    kind = rough_type(x, y)
    x4, y4, half = x.astype(kind), y.astype(kind), (size / 2).astype(kind)
    for cut in range(0, len(x), AT_ONCE):
        some = slice(cut, cut + AT_ONCE)
        own = (x[some] * x[some]).sum(1)
        wanted = None if whole else need[some][:, of]
        if wanted is not None and np.count_nonzero(wanted) < SPARSE * wanted.size:
            near, row = np.nonzero(wanted)
        else:
            rough = half[None, :] - x4[some] @ y4.T  # half the squared distance, less half of |x|^2
            if wanted is not None:
                rough[~wanted] = np.inf
            slack = ROUGH * (x.shape[1] + 4) * (np.sqrt(own) + far) * far
            limit = (reach[some] - own) / 2 + slack
            if not (limit < np.inf).all():
                limit = np.fmin(limit, np.partition(rough, many - 1, axis=1)[:, many - 1] + 2 * slack)
            limit = np.nextafter(limit.astype(kind), kind(np.inf))
            near, row = np.nonzero((rough <= limit[:, None]) & (rough < np.inf)) if np.isfinite(rough).any() else np.nonzero(wanted if wanted is not None else np.ones(rough.shape, bool))
        q.append(near + cut)
        at.append(row)
    q, at = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (q, at))
    d2 = np.empty(len(q))
    for cut in range(0, len(q), 8192):
        some = slice(cut, cut + 8192)
        d2[some] = ((y[at[some]] - x[q[some]]) ** 2).sum(1)
    order = np.lexsort((ids[at], d2, q))
    q, at, d2 = q[order], at[order], d2[order]
    rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(x)))[q]
    keep = rank < k
    return q[keep], at[keep], rank[keep], d2[keep]


def ranked(found: DataFrame, k: int, keys: Sequence[str] = QUERY) -> DataFrame:
    """The k best of each query's findings (keys, vec_id, d2), ties by vec_id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("d2", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", "vec_id", "d2")


def scale_queries(queries: DataFrame, alpha: float) -> DataFrame:
    """Queries over alpha: their nearest vectors are those whose alpha-fold is nearest to x, so one index serves every step."""
    if alpha == 0:
        raise ValueError("at alpha 0 every estimate is dataset_mean()")
    return queries.withColumn("x", F.transform("x", lambda e: e / alpha))


def require_k(neighbours: DataFrame, queries: DataFrame, k: int, keys: Sequence[str] = QUERY) -> DataFrame:
    """neighbours as they are; an error if a query has fewer than k."""
    few = queries.join(neighbours.groupBy(*keys).count(), list(keys), "left").where(F.coalesce("count", F.lit(0)) < k).count()
    if few:
        raise ValueError(f"{few} queries have fewer than {k} neighbours")
    return neighbours


def knn_regress(queries: DataFrame, vectors: DataFrame, neighbours: DataFrame, alpha: float, sigma: float,
                keys: Sequence[str] = QUERY, on: Sequence[str] = ()) -> DataFrame:
    """(keys, x_hat): kernel regression over the neighbours found, with distances taken anew to the scaled vectors."""
    rows = neighbours.select(*keys, "vec_id").join(queries, list(keys)).join(vectors.select(*on, "vec_id", "v"), [*on, "vec_id"])
    d2 = F.greatest(squared_distance("x", F.transform("v", lambda e: alpha * e)), F.lit(0.0))
    return merged(rows.select(*keys, (-d2 / (2 * sigma * sigma)).alias("top"), F.lit(1.0).alias("total"), F.col("v").alias("sums")), keys)


def dataset_mean(vectors: DataFrame) -> DataFrame:
    """(i, mean) by element: every query's estimate where no signal is left."""
    return vectors.select(F.posexplode("v").alias("i", "e")).groupBy("i").agg(F.avg("e").alias("mean"))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e)


def nearest_centres(x: np.ndarray, centres: np.ndarray, many: int = 1) -> np.ndarray:
    """The places of the `many` nearest centres of each row, nearest first."""
    rough = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return rough.argmin(1)[:, None] if many == 1 else np.argsort(rough, axis=1, kind="stable")[:, :many]


def nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of a centre that is nearest to each row as far as single precision tells: any list may have a row that is about as near to others."""
    kind = rough_type(x, centres)
    size, c, x = (centres * centres).sum(1).astype(kind) / 2, centres.T.astype(kind), x.astype(kind)
    return np.concatenate([(size - x[i : i + AT_ONCE] @ c).argmin(1) for i in range(0, len(x), AT_ONCE)])


def centres_of(x: np.ndarray, k: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """k-means centres of the rows of x; the distinct rows themselves if there are no more than k."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([nearest_centres(some, centres)[:, 0] for some in np.array_split(x, len(x) // BLOCK + 1)])
        by = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[by], prepend=-1))
        centres = centres.copy()
        centres[own[by][begins]] = np.add.reduceat(x[by], begins, axis=0) / np.diff(np.append(begins, len(x)))[:, None]
    return centres


def with_lists(rows: DataFrame, centroids: DataFrame, many: int, keys: Sequence[str], on: Sequence[str] = (), column: str = "x") -> DataFrame:
    """rows, repeated for the `many` lists whose centroids are nearest to `column`, with list_id. The rows go in blocks."""
    names = rows.columns

    def near(part: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(centres):
            return pd.DataFrame(columns=[*names, "list_id"], dtype=object)
        centres = centres.sort_values("list_id")
        at = nearest_centres(np.stack(part[column]), np.stack(centres["v"]), many)
        out = part[names].loc[part.index.repeat(at.shape[1])].reset_index(drop=True)
        out["list_id"] = centres["list_id"].to_numpy()[at.ravel()]
        return out

    centres = centroids.select(*on, "list_id", F.col("c").alias("v"))
    # all centroids of a group stay together: their number is about the root of the group's rows
    blocks = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__n"))
    sized = rows.join(blocks, list(on)) if on else rows.crossJoin(F.broadcast(blocks))
    copies = centres.join(blocks, list(on)) if on else centres.crossJoin(F.broadcast(blocks))
    a = sized.withColumn("block", F.pmod(F.xxhash64(*keys), F.col("__n"))).drop("__n").groupBy(*on, "block")
    b = copies.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n").groupBy(*on, "block")
    return a.cogroup(b).applyInPandas(near, fields(rows, names, ("list_id", "int")))
