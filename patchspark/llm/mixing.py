"""Mixing sources to target weights by Pareto order sampling.

Each document of a source is due `copies` = target / size of its source (times its weight, if weights are given, and
never more than `cap`). Its whole copies are certain; the rest is an inclusion probability p. Documents are ranked by
random odds over inclusion odds, (u/(1-u)) / (p/(1-p)), and the lowest ranks are taken until the source's words that
are still due are reached: a sample of fixed size with unequal probabilities. The cut is found from sums by rank bin,
so a source that holds a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchspark.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone: 52 bits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources in order, null last.

    The sources share the sum of all sizes by weight; a target stops at cap times its source's size, and the excess
    goes to the others by weight until none is above. One row per source is ordered in one task, not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("double").alias("w"),
                     (F.col("source_size") * float(cap)).alias("most"))
    up = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    per = per.select(
        "*", F.row_number().over(up).alias("k"),
        F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(all_rows).cast("double").alias("total"))
    left = F.col("total") - F.col("before")
    free = F.when(F.col("most") * F.col("rest") > F.col("w") * left, F.struct("k", left.alias("left"), "rest"))
    first = F.min(free).over(all_rows)
    return per.select("source", "source_size", first.alias("f"), "k", "w", "most").select(
        "source", "source_size",
        F.when(F.col("f").isNull() | (F.col("k") < F.col("f.k")), F.col("most"))
        .otherwise(F.col("w") * F.col("f.left") / F.col("f.rest")).alias("target"))


def _copies(rows: DataFrame, cap: int) -> DataFrame:
    """Adds copies by weight; what the cap cuts off is shared again within the source until none is above it."""
    now, n_capped = written(rows.withColumn("copies", F.lit(None).cast("double")), "shares"), 0
    while True:
        due = now.groupBy("key").agg(
            F.sum(F.when(F.col("copies").isNull(), F.col("size") * F.col("weight"))).alias("open"),
            F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0.0)).alias("spent"))
        share = F.when(F.col("open") > 0, (F.col("target") - F.col("spent")) / F.col("open") * F.col("weight")).otherwise(0.0)
        shared = now.join(due, "key").withColumn("share", share)
        now = written(shared.withColumn("copies", F.coalesce("copies", F.when(F.col("share") >= cap, F.lit(float(cap)))))
                      .select(*rows.columns, "copies", "share"), "shares")
        n = now.where("copies is not null").count()
        if n == n_capped:
            return now.withColumn("copies", F.coalesce("copies", "share")).drop("share")
        n_capped, now = n, now.drop("share")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, source (key), size, source_size, target, copies, times and taken.

    size: words of the text (null: 0); taken = times * size. Defined cases: a null source is a source of its own;
    empty texts take part with size 0; rows that share an id share its random number and, if other ranks tie, are
    taken in order of size; no rows give no rows; further columns of docs are not read. Reruns agree, as the random
    numbers come from the ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                       (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("weight"))
    rows = written(rows.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))), "sizes")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("key")
    targets = written(source_targets(rows, weights, cap).select(key, "source_size", "target"), "targets")
    due = rows.withColumn("key", key).join(targets, "key")
    if weight_col:
        due = _copies(due, cap)
    else:
        due = due.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    p, u = F.col("p"), uniform(F.col("doc_id"), seed)
    due = due.withColumn("whole", F.floor("copies").cast("double")).withColumn("p", F.col("copies") - F.col("whole"))
    due = written(due.withColumn("q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))).withColumn(
        "bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")), "ranks")
    # Words still due by source, and the bin of ranks in which they are reached.
    sums = due.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.first("target").alias("target"),
                                         F.sum(F.col("whole") * F.col("size")).alias("sure"))
    by_source = Window.partitionBy("key")
    upto = by_source.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    asked = F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(0)
    cut = sums.select("key", "bin", (F.first("target").over(by_source) - F.sum("sure").over(by_source)).alias("due"),
                      F.sum(asked).over(upto).alias("upto"), asked.alias("here")).where("bin is not null and upto > due")
    cut = cut.groupBy("key").agg(F.min(F.struct("bin", "due", (F.col("upto") - F.col("here")).alias("before"))).alias("cut"))
    due = due.join(written(cut, "cuts"), "key", "left").select(due["*"], "cut")
    inside = (F.col("bin") == F.col("cut.bin")) & F.col("q").isNotNull()
    outside = due.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "extra", F.when(F.col("q").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut.bin"))), 1.0).otherwise(0.0))
    ranked = Window.partitionBy("key").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("cut.before") + F.sum("size").over(ranked)
    within = due.where(inside).withColumn("upto", upto).withColumn("extra", F.when(
        (F.col("upto") <= F.col("cut.due")) | ((F.col("upto") - F.col("size") <= F.col("cut.due"))
                                               & (F.col("cut.due") * 2 >= F.col("upto") * 2 - F.col("size"))), 1.0).otherwise(0.0)).drop("upto")
    times = F.least(F.col("whole") + F.col("extra"), F.lit(float(cap))).cast("long")
    return outside.unionByName(within).select(
        "doc_id", "source", "size", "source_size", "target", "copies", times.alias("times"),
        (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as mix() takes them, with all their columns. Rows that share an id share a decision."""
    times = mix(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("times").alias("__times")).where("__times > 0")
    taken = docs.join(times, docs["doc_id"].eqNullSafe(times["__id"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select(*(docs[c] for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The sizes, targets, ranks and cuts of mix() over a table `docs`.
MIX_CTES = r"""
sizes AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM docs),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM per),
filled AS (SELECT *, row_number() OVER up AS k,
    coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    (sum(source_size) OVER ())::DOUBLE AS total FROM weighed WINDOW up AS (ORDER BY most / w, source NULLS LAST)),
free AS (SELECT k AS fk, total - before AS leftover, rest AS frest FROM filled WHERE most * rest > w * (total - before) ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN fk IS NULL OR k < fk THEN most ELSE w * leftover / frest END AS target
    FROM filled LEFT JOIN free ON true),
due AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p FROM due),
ranks AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
    target - sum(whole * size) OVER (PARTITION BY source) AS words_due FROM odds),
mixed AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranks),
timed AS (SELECT *, least(whole + CASE WHEN q IS NOT NULL AND (upto <= words_due OR (upto - size <= words_due
    AND words_due * 2 >= upto * 2 - size)) THEN 1 ELSE 0 END, 3)::BIGINT AS times FROM mixed)
"""

OP4_SQL = f"WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX_CTES} SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM timed"
