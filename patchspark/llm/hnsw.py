"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one node. Nodes are dealt to shards by a hash; each shard gets a graph; every node is
searched in every shard of its label, in blocks. An audit compares some searches of each block with a scan of the
shard, and the beam is doubled until enough of the links are found. A beam that fills with links may hide more of them,
so such a query is answered by a scan of the shard. Cosines are in double precision.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchspark.llm.components import connected_components
from patchspark.llm.shingles import mixed
from patchspark.llm.store import written

#: Neighbours a node keeps on the ground level and above, beam while building.
GROUND, UPPER, BUILD_BEAM = 24, 12, 48
#: Rows of a shard (each node is searched in every shard, so few and large ones are best; a graph of this size is built in
#: about a minute and held by one task), of a block of queries (a graph is sent to each block) and of a slice of it.
SHARD_ROWS, BLOCK_ROWS, SLICE = 32_768, 32_768, 1024
#: What a row without an id counts as.
LAST = 2**63 - 1


class Graph:
    """A navigable small-world graph over unit vectors; levels[0] is the ground."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        n = len(x)
        u = ((mixed(ids.view(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        self.level = np.minimum((-np.log(u) / np.log(UPPER)).astype(int), 12)
        self.levels = [np.full((n, GROUND if i == 0 else UPPER), -1, np.int32) for i in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        order = np.argsort(mixed(ids.view(np.uint64)), kind="stable")
        done = 0
        while done < n:
            size = min(max(64, done // 2), 512, n - done)
            self._insert(order[done : done + size], order[:done])
            done += size

    def _insert(self, new: np.ndarray, old: np.ndarray) -> None:
        found = self._descend(self.x[new], BUILD_BEAM, per_level=True) if len(old) else []
        among = self.x[new] @ self.x[new].T
        np.fill_diagonal(among, -2)
        for level, links in enumerate(self.levels):
            here = np.flatnonzero(self.level[new] >= level)
            if not len(here):
                break
            peers = np.where(self.level[new][None, :] >= level, among[here], -2)
            take = min(BUILD_BEAM, peers.shape[1])
            top = np.argsort(-peers, axis=1)[:, :take]
            ids, sims = new[top], np.take_along_axis(peers, top, 1)
            if level < len(found):
                ids = np.hstack([found[level][0][here], ids])
                sims = np.hstack([found[level][1][here], sims])
            links[new[here]] = self._diverse(ids, sims, links.shape[1])
            self._link_back(links, new[here])
        top = new[np.argmax(self.level[new])]
        if self.entry < 0 or self.level[top] > self.level[self.entry]:
            self.entry = int(top)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Up to `keep` candidates a row, best first; one that is nearer to a kept one than to the node comes last."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * keep]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        valid = (ids >= 0) & (sims > -1.5)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            hidden = (chosen[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1) if j else np.zeros(len(ids), bool)
            chosen[:, j] = valid[:, j] & ~hidden
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :keep]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)

    def _link_back(self, links: np.ndarray, nodes: np.ndarray) -> None:
        source = np.repeat(nodes, links.shape[1])
        target = links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        for cut in range(0, len(touched), 1024):
            some = slice(cut, cut + 1024)
            width = min(int(count[some].max()), 4 * links.shape[1])
            at = first[some][:, None] + np.arange(width)
            more = np.where(np.arange(width) < count[some][:, None], source[np.minimum(at, len(source) - 1)], -1)
            own = links[touched[some]]
            more = np.where((more[:, :, None] == own[:, None, :]).any(2), -1, more)
            ids = np.hstack([own, more])
            sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", self.x[touched[some]], self.x[np.maximum(ids, 0)]), -2)
            links[touched[some]] = self._diverse(ids, sims, links.shape[1])

    def _beam(self, q: np.ndarray, start: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes of each query that a best-first walk from its start nodes meets: (ids, cosines)."""
        n, m = len(q), len(self.x)
        seen = np.zeros((n, m + 1), bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qd,qkd->qk", q, self.x[np.maximum(ids[:, :width], 0)]), -2)
        np.put_along_axis(seen, np.where(ids < 0, m, ids), True, 1)
        walked = np.zeros((n, beam), bool)
        live = np.arange(n)
        while len(live):
            open_sims = np.where(walked[live] | (ids[live] < 0), -3, sims[live])
            best = open_sims.argmax(1)
            live, best = live[(ok := open_sims[np.arange(len(live)), best] > -2)], best[ok]
            if not len(live):
                break
            walked[live, best] = True
            near = links[ids[live, best]].astype(np.int64)
            near = np.where(near < 0, m, near)
            fresh = ~seen[live[:, None], near] & (near < m)
            seen[live[:, None], near] = True
            got = np.where(fresh, np.einsum("qd,qkd->qk", q[live], self.x[np.minimum(near, m - 1)]), -2)
            all_ids, all_sims = np.hstack([ids[live], near]), np.hstack([sims[live], got])
            all_walked = np.hstack([walked[live], ~fresh])
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], walked[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_walked))
            ids[live] = np.where(sims[live] > -2, ids[live], -1)
        return ids, sims

    def _descend(self, q: np.ndarray, beam: int, per_level: bool = False):
        out, start = [], np.full((len(q), 1), self.entry)
        for level in range(int(self.level[self.entry]), -1, -1):
            ids, sims = self._beam(q, start, self.levels[level], beam if per_level or not level else 4)
            out.append((ids, sims))
            start = ids
        return out[::-1] if per_level else out[-1]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self._descend(q, min(beam, len(self.x)))


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(graph: Graph, q: np.ndarray, own: np.ndarray, least: float, recall: float, audit: int) -> tuple[list[np.ndarray], int]:
    """The nodes of the graph with cosine >= least to each query but itself, and the beam that passed the audit."""
    n, beam = len(graph.x), 32
    probe = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    truth = [np.flatnonzero((row >= least) & (graph.ids != i)) for row, i in zip(q[probe] @ graph.x.T, own[probe], strict=True)]
    while True:
        if beam >= n:
            hits = [np.flatnonzero(row >= least) for row in q @ graph.x.T]
        else:
            ids, sims = graph.search(q, beam)
            hits = [i[s >= least] for i, s in zip(ids, sims, strict=True)]
            full = np.flatnonzero((sims >= least - 0.02).all(1))
            for at in np.array_split(full, max(1, len(full) // 256)) if len(full) else []:
                for k, row in zip(at, q[at] @ graph.x.T, strict=True):
                    hits[k] = np.flatnonzero(row >= least)
        hits = [h[graph.ids[h] != i] for h, i in zip(hits, own, strict=True)]
        found = sum(len(np.intersect1d(hits[k], t)) for k, t in zip(probe, truth, strict=True))
        if beam >= n or found >= recall * sum(map(len, truth)):
            return hits, beam
        beam *= 2


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
                 recall: float = 0.98, audit: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null and their cosine is at least `least`. audit queries of each
    slice are scanned in full; the beam grows until `recall` of their links are found. Defined cases: a vector that is
    null, zero, or holds null or non-finite numbers is linked with nothing; vectors of different lengths are not
    compared; equal vectors are linked with each other, also those of one vec_id; rows that share a vec_id and not the
    vector have links of their own, and what they are linked with is one component; a row without id counts as a link of
    others and as the last of its component, whose id is null if all ids are; no rows give no rows; columns that are not
    named are not read.
    """
    v = F.col("v")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    valid = F.coalesce(finite & F.exists(v, lambda e: e != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("same", F.when(valid, F.sha2(F.concat_ws(",", F.col("label"), v.cast("array<string>")), 256)))
    nodes = written(rows.where("same is not null").groupBy("same").agg(
        F.xxhash64("same").alias("id"), F.coalesce(F.min("vec_id"), F.lit(LAST)).alias("least"), F.count(F.lit(1)).alias("times"),
        F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    group = ["label", "dim"]
    nodes = nodes.withColumn("dim", F.size("v"))
    counts = nodes.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = written(nodes.join(counts, group).withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")), "placed")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        graph = Graph(_unit(part["v"]), part["id"].to_numpy())
        return pd.DataFrame({"label": key[0], "dim": key[1], "shard": key[2], "blocks": part["blocks"].iloc[0], "times": [part["times"].to_list()], "graph": [pickle.dumps(graph)]})

    graphs = written(placed.groupBy(*group, "shard").applyInPandas(build, "label string, dim int, shard int, blocks int, times array<long>, graph binary"), "graphs")

    def search(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        g, times = pickle.loads(graph["graph"].iloc[0]), np.array(graph["times"].iloc[0])
        own = queries["id"].to_numpy()
        hits = []
        for some in np.array_split(np.arange(len(own)), len(own) // SLICE + 1):
            if len(some):
                hits += _links(g, _unit(queries["v"].iloc[some]), own[some], least, recall, audit)[0]
        # the links as few edges: each node touched, and the smallest node it is joined with here
        place = {i: k for k, i in enumerate(np.union1d(own, g.ids).tolist())}
        names, up = list(place), list(range(len(place)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for i, hit in zip(own.tolist(), hits, strict=True):
            for j in g.ids[hit].tolist():
                a, b = root(place[i]), root(place[j])
                up[max(a, b)] = min(a, b)
        n_links = pd.DataFrame({"id": own, "other": own, "links": [int(times[h].sum()) for h in hits]})
        edges = [(names[k], names[r], 0) for k in range(len(names)) if (r := root(k)) != k]
        return pd.concat([n_links, pd.DataFrame(edges, columns=["id", "other", "links"])]).astype("int64")

    queries = placed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*group, "shard", "block", "id", "v")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*group, "shard", "block"]
    found = written(queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(search, "id long, other long, links long"), "vector-links")
    # components over the vectors' own numbers, joined where one vec_id has several vectors; then named by their smallest vec_id
    shared = rows.where("same is not null and vec_id is not null").select("vec_id", F.xxhash64("same").alias("id")).distinct()
    shared = shared.withColumn("first", F.min("id").over(Window.partitionBy("vec_id"))).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    comps = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(shared))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    info = written(nodes.join(links, "id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), "vector-components")
    named = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = written(info.join(named, "component").select("same", (F.col("links") + F.col("times") - 1).alias("n_links"), F.nullif("component_id", F.lit(LAST)).alias("component_id")), "vector-names")
    out = rows.join(info, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                                                 F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_hnsw(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and all that is reachable by links: for tables of some thousand vectors.
OP6_SQL = """
WITH RECURSIVE rows AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS good FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE a.good AND b.good AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS r FROM rows UNION SELECT id, b FROM reach JOIN links ON r = a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept FROM rows JOIN (SELECT id, min(r) AS low FROM reach GROUP BY 1) ON vec_id = id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) ON a = vec_id
"""
