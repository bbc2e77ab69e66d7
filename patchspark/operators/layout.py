"""Vectors laid out once in cells, and queries that go only to the cells they need.

lay_out() learns lists by distributed Lloyd rounds, puts neighbouring lists into cells and neighbouring cells into zones,
and writes the rows of a zone together in a table bucketed by zone, so that searches join with it without moving it: only
queries are shuffled, once for each zone in which they need a cell. Per group there is one row about its lists (centres,
rows, radii; LISTS at most, so its size is bounded); queries, packed by blocks, meet that row first and learn which cells
they need:

- regress(): cells whose weights can't reach `tolerance` of the sum, by the triangle inequality, are skipped;
- nearest(): the nprobe nearest lists; or, exactly, first the nearest list and then all lists that can hold a nearer row.

Zones are as large as a task can hold, or as small as gives all cores some, so queries are copied a few times and not once
for every cell. A group that many queries ask has copies of its cells, to which queries are dealt.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchspark.operators.kernel import AT_ONCE, PACKED, QUERY, add, better, fields, k_best, matrix, merged, nearest_list, packed, ranked, weighed
from patchspark.sources.steps import kept, scratch

#: Lists of a group at most, and rows of a list at least, unless a number is asked for.
LISTS, LIST_ROWS = 4096, 4
#: Queries of a block, and numbers in a packed row of a cell.
BLOCK, CELL_NUMBERS = PACKED, 1 << 17
#: Numbers in a zone at most, and zones of a layout for each core (as far as there are cells), if they could be fewer.
ZONE_NUMBERS, ZONES = 1 << 22, 2
#: Bytes of partial sums that a task holds before it hands them on.
HELD = 16 << 20
#: Queries that one copy of a group's cells is meant for.
SHARE = 1 << 18
#: Bytes of what is told of all lists up to which it is broadcast.
SMALL = 32 << 20


class Layout(NamedTuple):
    """rows (on, zone, copy, cell, data), bucketed by on, zone, copy; lists (on, copies, data): one row a group; columns that queries share."""

    rows: DataFrame
    lists: DataFrame
    on: tuple[str, ...]


class Lists(NamedTuple):
    """Centres of a group's lists, their rows, radii, cells and zones."""

    centres: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    cell: np.ndarray
    zone: np.ndarray


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, never below 0."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _latest(read: Callable[[bytes], object] = pickle.loads) -> Callable[[bytes], object]:
    """Reads pickled bytes; those that come again at once are not read again."""
    last: list = [None, None]

    def load(data: bytes):
        if data != last[0]:
            last[:] = data, read(data)
        return last[1]

    return load


def beside(blocks: DataFrame, one: DataFrame, on: Sequence[str]) -> DataFrame:
    """Packed blocks beside the one row of their group; a group of very many blocks is dealt to several tasks."""
    if not on:
        return blocks.crossJoin(F.broadcast(one))
    size = one.agg(F.sum(F.length("lists") if "lists" in one.columns else F.lit(64))).first()[0] or 0
    if size <= SMALL:
        return blocks.join(F.broadcast(one), list(on))
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = one.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return blocks.withColumn("__task", F.pmod("id", F.lit(tasks)).cast("int")).join(dealt, [*on, "__task"]).drop("__task")


def _learnt(blocks: DataFrame, counts: DataFrame, on: Sequence[str], nlist: int | None, rounds: int, seed: int, list_rows: int) -> DataFrame:
    """(on, lists): centres of each group, by Lloyd rounds over all blocks: rows are assigned in their tasks, sums are grouped by list."""
    share = F.least(F.lit(float(LISTS)), F.lit(float(nlist)) if nlist else F.ceil(F.col("many") / list_rows).cast("double"))
    asked = counts.select(*on, F.greatest(share, F.lit(1.0)).cast("int").alias("k"), "many")
    schema = fields(blocks, on, ("u", "double"), ("k", "int"), ("v", "array<double>"))

    def sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                keys, x = pickle.loads(row.data)
                u = (pd.util.hash_array(keys["vec_id"]) * np.uint64(2 * seed + 1)).astype(float) / 2.0**64
                at = np.flatnonzero(u < (1.5 * row.k + 16) / row.many)
                if len(at):
                    yield pd.DataFrame({**{c: getattr(row, c) for c in on}, "u": u[at], "k": row.k, "v": list(x[at])})

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("u")
        x = matrix(part["v"])
        distinct = np.sort(np.unique(x, axis=0, return_index=True)[1])[: int(part["k"].iloc[0])]
        return pd.DataFrame({**{c: part[c].iloc[:1] for c in on}, "lists": [pickle.dumps(x[distinct], 5)]})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: part[c].iloc[:1] for c in on}, "lists": [pickle.dumps(matrix(part.sort_values("list_id")["c"]), 5)]})

    schema_lists = fields(blocks, on, ("lists", "binary"))
    some = beside(blocks, asked, on).select(*on, "id", "data", "k", "many").mapInPandas(sampled, schema)
    centres = some.groupBy(*on).applyInPandas(first, schema_lists)

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, held = _latest(), {}

        def handed() -> Iterator[pd.DataFrame]:
            for group, (sums, n) in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({**dict(zip(on, group, strict=True)), "list_id": at, "top": 0.0, "total": n[at].astype(float), "sums": list(sums[at])})
            held.clear()

        for frame in frames:
            for row in frame.itertuples(index=False):
                c, x = load(row.lists), pickle.loads(row.data)[1]
                own = nearest_list(x, c)
                group = tuple(getattr(row, k) for k in on)
                sums, n = held.setdefault(group, (np.zeros(c.shape), np.zeros(len(c), np.int64)))
                np.add.at(sums, own, x)
                n += np.bincount(own, minlength=len(c))
                if sum(s.nbytes for s, _ in held.values()) > HELD:
                    yield from handed()
        yield from handed()

    for _ in range(rounds):
        # with top 0 a partial softmax is a sum and a count, so merged() gives means
        parts = beside(blocks, kept(centres), on).mapInPandas(added, fields(blocks, on, ("list_id", "int"), ("top", "double"), ("total", "double"), ("sums", "array<double>")))
        centres = merged(parts, [*on, "list_id"], "c").groupBy(*on).applyInPandas(pack, schema_lists)
    return centres


def _cells(centres: np.ndarray, rows_of_cell: float, n: float) -> np.ndarray:
    """The cell of each list: lists side by side on the widest axis are split in halves until a cell has about so many rows."""
    cell, todo, made = np.zeros(len(centres), np.int64), [(np.arange(len(centres)), max(1, round(n / rows_of_cell)))], 0
    while todo:
        at, parts = todo.pop()
        if parts <= 1 or len(at) < 2:
            cell[at] = made
            made += 1
            continue
        x = centres[at]
        order = at[np.argsort(x[:, x.var(0).argmax()], kind="stable")]
        cut = max(1, min(len(at) - 1, len(at) * (parts // 2) // parts))
        todo += [(order[:cut], parts // 2), (order[cut:], parts - parts // 2)]
    return cell


def lay_out(vectors: DataFrame, on: Sequence[str] = (), nlist: int | None = None, rounds: int = 4, seed: int = 7, queries: DataFrame | None = None,
            list_rows: int = LIST_ROWS) -> Layout:
    """Vectors (on, vec_id, v) in cells. queries: (on, n), how many queries a group will be asked, where that is known.

    nlist: lists of each group; by default a list has list_rows rows; there are LISTS lists at most. Rows of a group have
    one length. A group without finite centres is one list.
    """
    on = tuple(on)
    return lay_out_blocks(packed(vectors.select(*on, "vec_id", "v"), ["vec_id"], on, "v"), on, nlist, rounds, seed, queries, list_rows)


def lay_out_blocks(blocks: DataFrame, on: Sequence[str], nlist: int | None = None, rounds: int = 4, seed: int = 7, queries: DataFrame | None = None,
                   list_rows: int = LIST_ROWS) -> Layout:
    """lay_out() of packed blocks (on, id, n, data), whose key is vec_id. Without rounds, lists are around rows chosen by a hash."""
    on, spark, blocks = tuple(on), blocks.sparkSession, kept(blocks)
    counts = kept(blocks.groupBy(*on).agg(F.sum("n").alias("many")))
    share = -(-ZONES * spark.sparkContext.defaultParallelism // max(1, counts.count()))
    copies = F.lit(1) if queries is None else F.greatest(F.ceil(F.coalesce(F.col("n"), F.lit(0)) / SHARE), F.lit(1)).cast("int")
    learnt = _learnt(blocks, counts, on, nlist, rounds, seed, list_rows)
    about = learnt.join(counts, list(on)) if on else learnt.crossJoin(counts)
    if queries is not None and on:
        about = about.join(queries.select(*on, "n"), list(on), "left")

    def celled(frame: pd.DataFrame) -> pd.DataFrame:
        c = pickle.loads(frame["lists"].iloc[0])
        c = c if np.isfinite(c).all() else np.zeros((1, c.shape[1]))
        many = float(frame["many"].iloc[0])
        cell = _cells(c, CELL_NUMBERS / max(1, c.shape[1]), many)
        cells = int(cell.max()) + 1
        zones = min(cells, max(share, int(np.ceil(many * c.shape[1] / ZONE_NUMBERS))))
        data = pickle.dumps((c, cell, cell * zones // cells), 5)
        return pd.DataFrame({**{k: frame[k].iloc[:1] for k in on}, "copies": frame["copies"].iloc[:1], "lists": [data]})

    about = kept(about.withColumn("copies", copies).groupBy(*on).applyInPandas(celled, fields(blocks, on, ("copies", "int"), ("lists", "binary"))))

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block by cell."""
        load = _latest()
        for frame in frames:
            for row in frame.itertuples(index=False):
                (c, cell, zone), (keys, x) = load(row.lists), pickle.loads(row.data)
                own = nearest_list(x, c)
                order = np.argsort(cell[own], kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(cell[own][order])) + 1)
                first = own[[at[0] for at in parts]]
                data = [pickle.dumps((own[at], keys["vec_id"][at], x[at], np.linalg.norm(x[at] - c[own[at]], axis=1)), 5) for at in parts]
                yield pd.DataFrame({**{k: getattr(row, k) for k in on}, "copies": row.copies, "zone": zone[first], "cell": cell[first], "id": row.id, "numbers": [x[at].size for at in parts], "data": data})

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        own, ids, x, far = (np.concatenate(p) for p in zip(*map(pickle.loads, part["data"]), strict=True))
        order = np.lexsort((ids, own))
        lists, begins = np.unique(own[order], return_index=True)
        return pd.DataFrame({**{k: part[k].iloc[:1] for k in on}, "copies": part["copies"].iloc[:1], "zone": part["zone"].iloc[:1], "cell": part["cell"].iloc[:1], "lists": [lists], "n": [np.diff(np.append(begins, len(own)))],
                             "radius": [np.maximum.reduceat(far[order], begins)], "data": [pickle.dumps((own[order], ids[order], x[order]), 5)]})

    fragments = kept(beside(blocks, about, on).mapInPandas(assigned, fields(blocks, on, ("copies", "int"), ("zone", "long"), ("cell", "long"), ("id", "long"), ("numbers", "long"), ("data", "binary"))))
    # a cell of any size is in parts of about CELL_NUMBERS
    parts = fragments.groupBy(*on, "cell").agg(F.ceil(F.sum("numbers") / CELL_NUMBERS).alias("parts"))
    dealt = fragments.join(parts, [*on, "cell"]).withColumn("part", F.pmod("id", "parts"))
    told = ("lists", "array<long>"), ("n", "array<long>"), ("radius", "array<double>")
    cells = dealt.groupBy(*on, "cell", "part").applyInPandas(joined, fields(blocks, on, ("copies", "int"), ("zone", "long"), ("cell", "long"), *told, ("data", "binary")))
    laid = _bucketed(spark, cells.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"), [*on, "zone", "copy"])

    def listed(seen: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        c, cell, zone = pickle.loads(one["lists"].iloc[0])
        n, radius, at = np.zeros(len(c), np.int64), np.zeros(len(c)), seen["lists"].to_numpy()
        n[at], radius[at] = seen["n"], seen["radius"]
        return pd.DataFrame({**{k: one[k].iloc[:1] for k in on}, "copies": one["copies"].iloc[:1], "data": [pickle.dumps(Lists(c, n, radius, cell, zone), 5)]})

    each = laid.where("copy = 0").select(*on, F.explode(F.arrays_zip("lists", "n", "radius")).alias("l")).select(*on, "l.*")
    each = each.groupBy(*on, "lists").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    lists = kept(each.groupBy(*on).cogroup(about.groupBy(*on)).applyInPandas(listed, fields(blocks, on, ("copies", "int"), ("data", "binary"))))
    return Layout(laid.select(*on, "zone", "copy", "cell", "data"), lists, on)


def _bucketed(spark, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows as a table of its own, bucketed by keys: joins on them leave it where it lies."""
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"laid_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", scratch(spark, "laid")).option("parquet.block.size", 16 << 20)
    writer.saveAsTable(name)
    return spark.table(name)


def routed(blocks: DataFrame, layout: Layout, choose: Callable[[np.ndarray, Lists, dict], np.ndarray]) -> DataFrame:
    """(on, zone, copy, id, cells, data) for packed blocks (on, id, data): a row for each zone with cells that some of a block's queries need.

    choose(x, lists, keys) tells which query needs which list, as a boolean matrix.
    """
    on = layout.on

    def routes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = _latest()
        for frame in frames:
            for row in frame.itertuples(index=False):
                lists, (keys, x) = load(row.lists), pickle.loads(row.data)
                cuts = [slice(i, i + AT_ONCE) for i in range(0, len(x), AT_ONCE)]  # so that what choose() holds doesn't grow with the block
                need = np.concatenate([choose(x[c], lists, {k: v[c] for k, v in keys.items()}) for c in cuts])
                asked = need.any(0)
                zones, cells, out = np.unique(lists.zone[asked]), [], []
                for zone in zones.tolist():
                    of_zone = np.flatnonzero(asked & (lists.zone == zone))
                    at = np.flatnonzero(need[:, of_zone].any(1))
                    cells.append(np.unique(lists.cell[of_zone]))
                    out.append(pickle.dumps((len(x), at, {k: v[at] for k, v in keys.items()}, x[at], of_zone, np.packbits(need[np.ix_(at, of_zone)], axis=1)), 5))
                if len(zones):
                    yield pd.DataFrame({**{k: getattr(row, k) for k in on}, "zone": zones, "copy": np.int32(abs(int(row.id)) % row.copies), "id": row.id, "cells": cells, "data": out})

    both = beside(blocks.select(*on, "id", "data"), layout.lists.withColumnRenamed("data", "lists"), on)
    return both.select(*on, "id", "data", "lists", "copies").mapInPandas(routes, fields(blocks, on, ("zone", "long"), ("copy", "int"), ("id", "long"), ("cells", "array<long>"), ("data", "binary")))


def _joined(routes: DataFrame, layout: Layout) -> DataFrame:
    """Routes beside the rows of their cells: the layout isn't moved, whatever its size."""
    both = routes.join(layout.rows.withColumnRenamed("data", "rows").hint("merge"), [*layout.on, "zone", "copy"])
    return both.where(F.array_contains("cells", F.col("cell"))).select("id", "data", "rows")


def _asking(data: bytes) -> tuple:
    """A route: (rows of its block, places of its queries there, their keys, themselves, lists, which query needs which list)."""
    n, at, own, x, lists, bits = pickle.loads(data)
    return n, at, own, x, lists, np.unpackbits(bits, axis=1, count=len(lists)).astype(bool)


def _wanted(need: np.ndarray, lists: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries that need a list of a cell, lists of the cell, the list of each row as a place there): of is sorted."""
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    here, place = of[begins], np.minimum(np.searchsorted(lists, of[begins]), len(lists) - 1)
    need = need[:, place] & (lists[place] == here)
    return np.flatnonzero(need.any(1)), need, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(of))))


def reaching(alpha: float, sigma: float, tolerance: float) -> Callable[[np.ndarray, Lists, dict], np.ndarray]:
    """Lists whose weights may matter: all lists left out of a query together stay below `tolerance` of its sum of weights."""
    def choose(x: np.ndarray, lists: Lists, keys: dict) -> np.ndarray:
        near = np.sqrt(_squares(x, alpha * lists.centres))
        slack = 1e-9 * (1 + near)
        with np.errstate(divide="ignore"):
            many = np.log(lists.n)
        most = many - np.maximum(near - alpha * lists.radius - slack, 0) ** 2 / (2 * sigma * sigma)
        least = many - (near + alpha * lists.radius + slack) ** 2 / (2 * sigma * sigma)
        top = least.max(1, keepdims=True)
        weight = np.exp(np.minimum(most - top, 700))
        order = np.argsort(weight, axis=1)
        dropped = np.cumsum(np.take_along_axis(weight, order, 1), axis=1) <= tolerance
        need = np.empty(weight.shape, bool)
        np.put_along_axis(need, order, ~dropped, 1)
        return need & (lists.n > 0)

    return choose


def probing(nprobe: int) -> Callable[[np.ndarray, Lists, dict], np.ndarray]:
    """The nprobe lists with the nearest centres; lists without rows don't count."""
    def choose(x: np.ndarray, lists: Lists, keys: dict) -> np.ndarray:
        need = np.zeros((len(x), len(lists.n)), bool)
        if nprobe >= need.shape[1]:
            return need | (lists.n > 0)
        near = np.where(lists.n > 0, _squares(x, lists.centres), np.inf)
        np.put_along_axis(need, np.argpartition(near, nprobe - 1, axis=1)[:, :nprobe], True, 1)
        return need & (lists.n > 0)

    return choose


def within(x: np.ndarray, lists: Lists, keys: dict) -> np.ndarray:
    """Lists that can hold a row no further from a query than its `__reach`, by the triangle inequality."""
    near = np.sqrt(_squares(x, lists.centres))
    return (near - lists.radius - 1e-9 * (1 + near) <= keys["__reach"][:, None]) & (lists.n > 0)


def regress_blocks(blocks: DataFrame, queries: DataFrame, layout: Layout, alpha: float, sigma: float, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, x_hat) of packed blocks; queries only tells the types of keys."""
    if sigma <= 0:
        raise ValueError("sigma must be above 0")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, held = _latest(_asking), {}

        def handed() -> Iterator[pd.DataFrame]:
            for i, part in held.items():
                yield pd.DataFrame({"id": [i], "data": [pickle.dumps(part, 5)]})
            held.clear()

        for frame in frames:
            for row in frame.itertuples(index=False):
                (n, at, own, x, lists, need), (of, _, y) = load(row.data), pickle.loads(row.rows)
                part = held.get(row.id)
                if part is None:
                    # the rows of a block's other cells of a zone follow at once
                    if sum(p[3].nbytes for p in held.values()) > HELD:
                        yield from handed()
                    part = held[row.id] = {k: np.empty(n, v.dtype) for k, v in own.items()}, np.full(n, -np.inf), np.zeros(n), np.zeros((n, x.shape[1]))
                q = _wanted(need, lists, of)[0]
                for k, v in own.items():
                    part[0][k][at[q]] = v[q]
                add(part, at[q], *weighed(x[q], y, alpha, sigma, part[1][at[q]]))
        yield from handed()

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partials of a block come one after the other."""
        now, part = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame({**part[0], "x_hat": list(part[3] / part[2][:, None])})

        for frame in frames:
            for i, data in zip(frame["id"], frame["data"], strict=True):
                more = pickle.loads(data)
                if i != now:
                    if part is not None:
                        yield done()
                    now, part = i, more
                    continue
                at = np.flatnonzero(more[2] > 0)
                for k, v in more[0].items():
                    part[0][k][at] = v[at]
                add(part, at, more[1][at], more[2][at], more[3][at])
        if part is not None:
            yield done()

    parts = _joined(routed(blocks, layout, reaching(alpha, sigma, tolerance)), layout).mapInPandas(partial, "id long, data binary")
    return parts.repartition("id").sortWithinPartitions("id").mapInPandas(summed, fields(queries, keys, ("x_hat", "array<double>")))


def regress(queries: DataFrame, layout: Layout, alpha: float, sigma: float, keys: Sequence[str] = QUERY, tolerance: float = 1e-12) -> DataFrame:
    """(keys, x_hat): kernel_regress() of queries (keys, on, x) without the cells that can't matter."""
    return regress_blocks(packed(queries, keys, layout.on, "x"), queries, layout, alpha, sigma, keys, tolerance)


def needed(queries: DataFrame, layout: Layout, choose: Callable, keys: Sequence[str] = QUERY) -> DataFrame:
    """(pairs, needed, rows, scanned): query and list pairs, those that choose() keeps, and the same by rows of the lists."""
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                lists, (own, x) = pickle.loads(row.lists), pickle.loads(row.data)
                need = choose(x, lists, own)
                yield pd.DataFrame({"pairs": [need.size], "needed": [int(need.sum())], "rows": [len(x) * int(lists.n.sum())], "scanned": [int((need @ lists.n).sum())]})

    both = beside(packed(queries, keys, layout.on, "x"), layout.lists.withColumnRenamed("data", "lists"), layout.on)
    return both.mapInPandas(counted, "pairs long, needed long, rows long, scanned long").agg(*(F.sum(c).alias(c) for c in ("pairs", "needed", "rows", "scanned")))


def _found(routes: DataFrame, layout: Layout, k: int, queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, vec_id, d2, list_id): the k nearest rows of each query in each packed row of its cells, in the lists it needs."""
    names = [*keys, "vec_id", "d2", "list_id"]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, now, part = _latest(_asking), None, None

        def done() -> pd.DataFrame:
            own, d2, found, of = part
            q, rank = np.nonzero(np.isfinite(d2))
            return pd.DataFrame({**{c: own[c][q] for c in keys}, "vec_id": found[q, rank], "d2": d2[q, rank], "list_id": of[q, rank]})[names]

        for frame in frames:
            for row in frame.itertuples(index=False):
                (_, _, own, x, lists, need), (of, ids, y) = load(row.data), pickle.loads(row.rows)
                if row.data is not now and row.data != now:
                    if part is not None:
                        yield done()
                    now, part = row.data, [own, np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64), np.zeros((len(x), k), np.int64)]
                asked, of_cell, place = _wanted(need, lists, of)
                q, at, rank, d2 = k_best(x[asked], y, ids, of_cell[asked], place, k, part[1][asked, k - 1])
                better(part, asked, k, (q, rank), d2, ids[at], of[at])
        if part is not None:
            yield done()

    return _joined(routes, layout).mapInPandas(best, fields(queries, keys, ("vec_id", "long"), ("d2", "double"), ("list_id", "long")))


def knn_regress_blocks(blocks: DataFrame, queries: DataFrame, layout: Layout, k: int, nprobe: int, alpha: float, sigma: float, keys: Sequence[str]) -> DataFrame:
    """(keys, x_hat) of packed blocks: kernel regression over the k rows whose alpha-fold is nearest, of nprobe lists; null if there are fewer.

    Neighbours travel with their distances, so nothing is looked up afterwards.
    """
    if sigma <= 0 or alpha == 0:
        raise ValueError("sigma must be above 0, and alpha not 0")
    choose = probing(nprobe)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, held = _latest(_asking), {}

        def handed() -> Iterator[pd.DataFrame]:
            for i, part in held.items():
                yield pd.DataFrame({"id": [i], "data": [pickle.dumps(part, 5)]})
            held.clear()

        for frame in frames:
            for row in frame.itertuples(index=False):
                (n, at, own, x, lists, need), (of, ids, y) = load(row.data), pickle.loads(row.rows)
                if row.id not in held:
                    if sum(p[3].nbytes for p in held.values()) > HELD:
                        yield from handed()
                    held[row.id] = [{c: np.empty(n, v.dtype) for c, v in own.items()}, np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k, x.shape[1]))]
                part = held[row.id]
                asked, of_cell, place = _wanted(need, lists, of)
                for c, v in own.items():
                    part[0][c][at[asked]] = v[asked]
                q, found, rank, d2 = k_best(x[asked] / alpha, y, ids, of_cell[asked], place, k, part[1][at[asked], k - 1])
                better(part, at[asked], k, (q, rank), d2, ids[found], y[found])
        yield from handed()

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part = None, None

        def done() -> pd.DataFrame:
            own, d2, _, v = part
            whole = np.isfinite(d2).all(1)
            w = np.exp(-alpha * alpha * np.where(whole[:, None], d2 - d2[:, :1], 0) / (2 * sigma * sigma))
            hat = (w[:, :, None] * v).sum(1) / w.sum(1, keepdims=True)
            return pd.DataFrame({**own, "x_hat": [h if ok else None for h, ok in zip(hat, whole, strict=True)]})

        for frame in frames:
            for i, data in zip(frame["id"], frame["data"], strict=True):
                more = pickle.loads(data)
                if i != now:
                    if part is not None:
                        yield done()
                    now, part = i, more
                    continue
                at = np.flatnonzero(np.isfinite(more[1][:, 0]))
                for c, v in more[0].items():
                    part[0][c][at] = v[at]
                q, rank = np.nonzero(np.isfinite(more[1]))
                better(part, np.arange(len(part[1])), k, (q, rank), more[1][q, rank], more[2][q, rank], more[3][q, rank])
        if part is not None:
            yield done()

    routes = routed(blocks, layout, lambda x, lists, own: choose(x / alpha, lists, own))
    parts = _joined(routes, layout).mapInPandas(partial, "id long, data binary")
    return parts.repartition("id").sortWithinPartitions("id").mapInPandas(summed, fields(queries, keys, ("x_hat", "array<double>")))


def group_means(layout: Layout) -> DataFrame:
    """(on, mean): the estimate of every query of a group where no signal is left; sums of packed rows are merged."""
    on = layout.on

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = [(x.sum(0), float(len(x))) for _, _, x in map(pickle.loads, frame["data"])]
            yield pd.DataFrame({**{c: frame[c] for c in on}, "top": 0.0, "total": [n for _, n in sums], "sums": [x for x, _ in sums]})

    rows = layout.rows.where(F.col("copy") == 0).select(*on, "data")
    return merged(rows.mapInPandas(added, fields(rows, on, ("top", "double"), ("total", "double"), ("sums", "array<double>"))), on, "mean")


def nearest(queries: DataFrame, layout: Layout, k: int, nprobe: int | None = None, keys: Sequence[str] = QUERY) -> DataFrame:
    """(keys, rank, vec_id, d2): the k nearest rows, ties by vec_id: exactly, or those in the nprobe nearest lists.

    Exactly: the nearest lists with k rows or more tell how far the k-th may be; then all lists are asked that can hold a
    row as near as that.
    """
    names = list(dict.fromkeys([*keys, *layout.on, "x"]))
    queries = queries.select(*names)
    if nprobe is not None:
        return ranked(_found(routed(packed(queries, keys, layout.on, "x"), layout, probing(nprobe)), layout, k, queries, keys), k, keys)

    def first(x: np.ndarray, lists: Lists, own: dict) -> np.ndarray:
        near = np.where(lists.n > 0, _squares(x, lists.centres), np.inf)
        order = np.argsort(near, axis=1, kind="stable")
        before = np.cumsum(lists.n[order], axis=1) - lists.n[order]
        need = np.empty(near.shape, bool)
        np.put_along_axis(need, order, before < k, 1)
        return need & (lists.n > 0)

    start = ranked(_found(routed(packed(queries, keys, layout.on, "x"), layout, first), layout, k, queries, keys), k, keys)
    reach = start.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).otherwise(float("inf")).alias("__reach"))
    asked = kept(queries.join(reach, list(keys), "left").withColumn("__reach", F.coalesce("__reach", F.lit(float("inf")))))
    blocks = packed(asked, [*keys, "__reach"], layout.on, "x")
    return ranked(_found(routed(blocks, layout, within), layout, k, queries, keys), k, keys)


def audited_probes(queries: DataFrame, layout: Layout, k: int, recall: float, nprobe: int = 1, audit: int = 128, keys: Sequence[str] = QUERY) -> int:
    """The smallest number of lists, nprobe at least, in which `audit` of the queries find `recall` of their k nearest.

    The true neighbours are found in all lists of the table as it is laid out; how near a query their lists are, of all lists, tells the
    number at once. It is aimed two standard errors above recall, as only a sample is audited. At most audit * k numbers come to the driver.
    """
    some = kept(queries.select(*dict.fromkeys([*keys, *layout.on, "x"])).orderBy(F.xxhash64(*keys), *keys).limit(audit))
    blocks = packed(some, keys, layout.on, "x")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("d2", "vec_id"))
    truth = _found(routed(blocks, layout, probing(LISTS)), layout, k, some, keys).withColumn("rank", rank).where(F.col("rank") <= k)

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                lists, (own, x) = pickle.loads(row.lists), pickle.loads(row.data)
                near = np.where(lists.n > 0, _squares(x, lists.centres), np.inf)
                place = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1, kind="stable")
                yield pd.DataFrame({**{c: np.repeat(own[c], near.shape[1]) for c in keys}, "list_id": np.tile(np.arange(near.shape[1]), len(x)), "place": place.ravel()})

    both = beside(blocks, layout.lists.withColumnRenamed("data", "lists"), layout.on)
    ranks = both.mapInPandas(places, fields(some, keys, ("list_id", "long"), ("place", "long")))
    found = sorted(r[0] for r in truth.join(ranks, [*keys, "list_id"]).select("place").collect())
    if not found:
        return nprobe
    aim = min(1.0, recall + 2 * (recall * (1 - recall) / len(found)) ** 0.5)
    return max(nprobe, found[max(0, int(np.ceil(aim * len(found))) - 1)] + 1)


def knn_ivf(queries: DataFrame, layout: Layout, k: int, nprobe: int = 2, recall: float | None = None, audit: int = 128, keys: Sequence[str] = QUERY) -> DataFrame:
    """(keys, rank, vec_id, d2) from the nprobe nearest lists, or from as many as an audit finds to give `recall`; LISTS give all rows."""
    if recall is not None:
        nprobe = audited_probes(queries, layout, k, recall, nprobe, audit, keys)
    return nearest(queries, layout, k, nprobe, keys)


def as_tables(layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(on, list_id, c) of lists with rows, and (on, list_id, vec_id, v) of all rows."""
    on = layout.on

    def centres(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                lists = pickle.loads(row.data)
                at = np.flatnonzero(lists.n)
                yield pd.DataFrame({**{c: getattr(row, c) for c in on}, "list_id": at, "c": list(lists.centres[at])})

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                own, ids, x = pickle.loads(row.data)
                yield pd.DataFrame({**{c: getattr(row, c) for c in on}, "list_id": own, "vec_id": ids, "v": list(x)})

    every = layout.rows.where("copy = 0").select(*on, "data")
    return (layout.lists.mapInPandas(centres, fields(layout.lists, on, ("list_id", "int"), ("c", "array<double>"))),
            every.mapInPandas(rows, fields(every, on, ("list_id", "int"), ("vec_id", "long"), ("v", "array<double>"))))
