"""Product-quantised inverted lists: vectors as a list and a few codes, ranked by distances looked up in small tables.

Code books are learnt on a bounded sample, every vector is coded. A list of many rows is searched in blocks, so that no
task holds a whole list; the best by codes are ranked again by their raw vectors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchspark.operators.kernel import BLOCK, QUERY, centres_of, dealt, knn_flat, nearest_centres, ranked, squared_distance, with_lists
from patchspark.operators.layout import as_tables, lay_out
from patchspark.sources.steps import kept

#: Codes of each part of a vector: what one byte tells apart.
CODES = 256
#: Rows of a list, and queries whose tables are looked up at once.
LIST_ROWS, AT_ONCE = 64, 64


class Quantised(NamedTuple):
    """centroids (list_id, c), codebook (part, code, c) of at most CODES rows a part, codes (vec_id, list_id, code array), raw vectors (vec_id, v)."""

    centroids: DataFrame
    codebook: DataFrame
    codes: DataFrame
    vectors: DataFrame


def parts_of(dim: int, wanted: int = 16) -> int:
    """The most parts of equal width, up to `wanted`, that a vector of `dim` numbers can be cut into."""
    if wanted < 1:
        raise ValueError("a vector has at least one part")
    return max(d for d in range(1, min(wanted, dim) + 1) if dim % d == 0)


def _books(codebook: DataFrame) -> np.ndarray:
    """(parts, CODES, width); codes that do not exist are infinitely far. At most CODES times a vector's length numbers."""
    rows = codebook.collect()
    books = np.full((1 + max(r["part"] for r in rows), CODES, len(rows[0]["c"])), np.inf)
    for r in rows:
        books[r["part"], r["code"]] = r["c"]
    return books


def fit_ivfpq(vectors: DataFrame, nlist: int | None = None, pq_m: int = 16, sample: int = 100_000, seed: int = 7) -> Quantised:
    """Lists and codes of vectors (vec_id, v) of one length; what is coded is the difference from the list's centroid.

    sample bounds about how many rows each code book is learnt from.
    """
    centroids, lists = map(kept, as_tables(lay_out(vectors, nlist=nlist, seed=seed, list_rows=LIST_ROWS)))
    rest = lists.join(centroids, "list_id").select("vec_id", "list_id", F.zip_with("v", "c", lambda a, b: a - b).alias("rest"))
    n, dim = lists.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts = parts_of(dim, pq_m)
    width = dim // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("part"), F.slice("rest", i * width + 1, width).alias("s")))

    def learn(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        centres = centres_of(np.stack(some["s"]), CODES, seed, 12)
        return pd.DataFrame({"part": key[0], "code": range(len(centres)), "c": list(centres)})

    chosen = rest.sample(min(1.0, sample / max(1, n)), seed) if n > sample else rest
    codebook = kept(chosen.select(F.explode(cut).alias("p")).select("p.*").groupBy("part").applyInPandas(learn, "part int, code int, c array<double>"))
    books = _books(codebook)

    @F.pandas_udf("array<int>")
    def coded(v: pd.Series) -> pd.Series:
        x = np.stack(v).reshape(len(v), parts, width)
        real = np.isfinite(books[:, :, 0]).sum(1)
        return pd.Series(list(np.stack([nearest_centres(x[:, i], books[i, : real[i]])[:, 0] for i in range(parts)], axis=1).astype(np.int32)))

    return Quantised(centroids, codebook, kept(rest.select("vec_id", "list_id", coded("rest").alias("code"))), lists.select("vec_id", "v"))


def by_codes(queries: DataFrame, index: Quantised, k: int, nprobe: int = 2, rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, d2) by quantised distance in the nprobe nearest lists; d2 is that of the coded vector."""
    books = _books(index.codebook)
    parts = np.arange(len(books))
    aimed = with_lists(queries.select("query_id", "x"), index.centroids, nprobe, QUERY).join(index.centroids, "list_id").select(
        "query_id", "list_id", F.zip_with("x", "c", lambda a, b: a - b).alias("rest"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query_id", "vec_id", "d2"], dtype=object)
        b = b.sort_values("vec_id")
        codes, ids, rest, out = np.stack(b["code"]), b["vec_id"].to_numpy(), np.stack(a["rest"]), []
        many = min(k, len(ids))
        for cut in range(0, len(rest), AT_ONCE):
            x = rest[cut : cut + AT_ONCE].reshape(-1, len(books), 1, books.shape[2])
            table = ((x - books[None]) ** 2).sum(3)  # query, part, code
            d2 = sum(table[:, p, codes[:, p]] for p in parts.tolist())
            limit = np.partition(d2, many - 1, axis=1)[:, many - 1]
            q, at = np.nonzero(d2 <= limit[:, None])
            order = np.lexsort((at, d2[q, at], q))
            q, at = q[order], at[order]
            keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(x)))[q] < many
            out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy()[cut + q[keep]], "vec_id": ids[at[keep]], "d2": d2[q[keep], at[keep]]}))
        return pd.concat(out)

    found = dealt(aimed, index.codes.select("list_id", "vec_id", "code"), QUERY, ["list_id"], rows).applyInPandas(best, "query_id long, vec_id long, d2 double")
    return ranked(found, k)


def knn_ivfpq(queries: DataFrame, index: Quantised, k: int, nprobe: int = 2, rows: int = BLOCK, recall: float | None = None, audit: int = 100, spare: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, d2): the best spare * k by codes in the nprobe nearest lists, ranked by their raw vectors.

    recall: if given, `audit` queries with their true neighbours tell nprobe at once (how near their lists are, of all lists; half of what
    may be missed is left to lists), then spare is doubled until this share is found; both are aimed two standard errors higher.
    """
    def search(some: DataFrame, n: int, spare: int) -> DataFrame:
        near = by_codes(some, index, spare * k, n, rows).select("query_id", "vec_id")
        again = near.join(some.select("query_id", "x"), "query_id").join(index.vectors, "vec_id")
        return ranked(again.select("query_id", "vec_id", squared_distance("x", "v").alias("d2")), k)

    if recall is not None:
        some = kept(queries.select("query_id", "x").orderBy(F.xxhash64("query_id"), "query_id").limit(audit))
        truth = kept(knn_flat(some, index.vectors, k).select("query_id", "vec_id"))
        near = F.row_number().over(Window.partitionBy("query_id").orderBy(squared_distance("x", "c"), "list_id"))
        places = some.crossJoin(F.broadcast(index.centroids)).select("query_id", "list_id", near.alias("place"))  # audit * lists rows
        found = sorted(r[0] for r in truth.join(index.codes.select("vec_id", "list_id"), "vec_id").join(places, ["query_id", "list_id"]).select("place").collect())
        if found:
            aim = min(1.0, recall + 2 * (recall * (1 - recall) / len(found)) ** 0.5)
            nprobe = max(nprobe, found[math.ceil((1 + aim) / 2 * len(found)) - 1])
            most = index.codes.count()
            while spare * k < most and search(some, nprobe, spare).join(truth, ["query_id", "vec_id"], "left_semi").count() < aim * len(found):
                spare *= 2
    return search(queries, nprobe, spare)
