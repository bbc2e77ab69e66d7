"""Quality classification by a sparse rule ensemble.

Statistics of a text are Spark column expressions. Trees grown on a bounded labelled sample give conjunctive rules
(every path from a root), a lasso logistic regression over the rules keeps a few with weights, and those are compiled
into one Spark column expression, so that scoring the corpus is a scan without Python.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchspark.llm.langid import remainder
from patchspark.llm.mixing import uniform
from patchspark.llm.store import written
from patchspark.llm.trees import holds, paths

FEATURES = ["log_chars", "mean_word", "upper", "digits", "symbols", "bars", "marks", "distinct", "repeats", "lines", "stops"]


def statistics(text: Column) -> list[Column]:
    """The FEATURES of a whole text, as columns that are never null; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words, n_chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))

    def count(chars: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]+", ""))

    repeated = F.aggregate(words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
                           lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")))["n"]
    return [c.alias(name) for name, c in zip(FEATURES, [
        F.log1p(F.length(t)), F.length(t) / n_words, count(r"\p{Lu}") / n_chars, count("0-9") / n_chars,
        count(r"#$%&*@^~=<>+_\\/") / n_chars, count("|") / n_words, count("!?") / n_words,
        F.size(F.array_distinct(words)) / n_words, repeated / n_words, count("\n") / n_words, count(".") / n_words], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, trees: int = 30, depth: int = 3, penalty: float = 0.002) -> dict:
    """Rules and weights from labels (doc_id, label) and the texts of docs (doc_id, text).

    max_rows bounds the labelled rows used, chosen by a hash of the id; that sample alone is broadcast. A repeated
    label counts once (the largest). With one class or no rows the model is a constant: (ones + 1) / (rows + 2).
    """
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    chosen = written(chosen.orderBy(uniform(F.col("doc_id"), "quality"), "doc_id").limit(max_rows), "quality-labels")
    own = docs.join(F.broadcast(chosen), "doc_id").select("label", *statistics(F.col("text")))
    sample = written(own.repartition(4), "quality-sample").cache()
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return {"bias": math.log((ones + 1) / (n - ones + 1)), "rules": []}
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample)
    forest = RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7,
                                   featureSubsetStrategy="0.5", subsamplingRate=0.7).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule, _, _ in paths(tree) if rule})
    if not rules:
        return {"bias": math.log((ones + 1) / (n - ones + 1)), "rules": []}
    features = [F.col(f) for f in FEATURES]
    held = sample.select("label", *(holds(r, features).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("label", "x").cache()
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(held)
    weights = lasso.coefficients.toArray()
    held.unpersist()
    sample.unpersist()
    return {"bias": float(lasso.intercept), "rules": [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]}


def scored(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows of docs (doc_id, text) with score (0 to 1) and predicted (score >= least). Null texts count as empty."""
    stats = docs.select("doc_id", *statistics(F.col("text")))
    features, total = [F.col(f) for f in FEATURES], F.lit(model["bias"])
    for rule, weight in model["rules"]:
        total += F.when(holds(rule, features), F.lit(weight)).otherwise(0.0)
    score = 1 / (1 + F.exp(-total))
    return stats.select("doc_id", score.alias("score")).select("doc_id", "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0)
    model = fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "score", "predicted")
