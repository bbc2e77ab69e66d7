"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

Digests of normalised texts are sketched in one pass by Spark's frequent-items aggregate (a mergeable Misra-Gries
summary: every digest in more than about one row of `tracked` is in it). The few frequent digests are then counted
exactly and verified; these winners are broadcast (at most `heavy` rows), so that their copies are decided on the map
side. All other digests have at most a bounded share of the rows and are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchspark.llm.store import written

#: White space that counts as one space.
SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["text_sha256", "n_chars_norm", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n_chars_norm, check) of each row; a null text counts as empty."""
    norm = docs.select(F.col(id_col).alias("doc_id"),
                       F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ").alias("norm"))
    return norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"),
                       F.length("norm").alias("n_chars_norm"), F.xxhash64("norm").alias("check"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = 1000, tracked: int = 10000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of white space became one space (the ends are not stripped). Of equal
    texts the row with the smallest doc_id stays. Defined cases: a null text equals the empty one; a null doc_id loses
    to any other and stays only in a group without ids; rows that share the winning doc_id all stay; other columns,
    whatever their names, are not read; no rows give no rows.
    heavy, tracked: at most this many digests are broadcast, out of this many counters of the sketch.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    sketch = rows.agg(F.count(F.lit(1)).alias("n"),
                      F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    frequent = sketch.select("n", F.explode("top").alias("t")).where(
        F.greatest(F.col("n") / tracked, F.lit(2.0)) <= F.col("t.count")).select(F.col("t.item").alias("text_sha256"))
    group = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    counted = rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(
        *group, *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in _KEY[1:]))
    verified = written(counted.where("min_n_chars_norm = max_n_chars_norm and min_check = max_check").select(
        "text_sha256", "keep_id", "group_size"), "winners")
    on_map_side = rows.join(F.broadcast(verified), "text_sha256").select(
        "doc_id", "keep_id", "group_size", "text_sha256")
    same = Window.partitionBy(*_KEY)
    shuffled = rows.join(F.broadcast(verified), "text_sha256", "left_anti").select(
        "doc_id", F.min("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"), "text_sha256")
    return on_map_side.unionAll(shuffled).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    digest = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACE, " "), 256)
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]) & (digest == stay["__digest"]), "left_semi")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
