"""Language identification by nearest centroid over TF-IDF byte n-grams.

A text is lower-cased; its letters' bytes and the gaps between words give 2- and 3-grams, hashed into `DIM` counts,
weighed (1 + log count) * idf and normalised. Each language has a few centroids, from spherical k-means over a bounded
sample of its labelled texts; a text takes the language of the centroid with the highest cosine, and is rejected if it
is further from it than anything like the texts that made it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchspark.llm.mixing import uniform
from patchspark.llm.store import written

DIM = 8192
#: Bytes of text that are counted at once.
AT_ONCE = 1 << 20
#: Different n-grams from which on a text must be as near as the sample's; the fewer it has, the further it may be.
ENOUGH = 100
UND = "und"

# 0 for what is no letter, 1-26 for a-z, 27-154 for the bytes of other characters
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def _add_grams(symbols: np.ndarray, rows: np.ndarray, start: int, end: int, out: np.ndarray) -> None:
    """Adds the 2- and 3-grams that begin in symbols[start:end] to their rows' counts; none spans two rows."""
    low, high = rows[start], rows[end - 1] + 1
    for n, base in ((2, 0), (3, 155 * 155)):
        stop = min(end, len(symbols) - n + 1)
        if stop <= start:
            continue
        gram = symbols[start:stop]
        for k in range(1, n):
            gram = gram * 155 + symbols[start + k : stop + k]
        at = rows[start:stop]
        keep = (at == rows[start + n - 1 : stop + n - 1]) & (symbols[start + n - 2 : stop + n - 2] > 0)
        slot = ((gram[keep] + base) * 0x9E3779B1 >> 7) % DIM
        out[low:high] += np.bincount((at[keep] - low) * DIM + slot, minlength=(high - low) * DIM).reshape(-1, DIM)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """A row of n-gram counts for each lower-cased UTF-8 text. Texts of any length count whole, a slice at a time."""
    out = np.zeros((len(texts), DIM))
    symbols = _CLASS[np.frombuffer(b"\n".join(texts), np.uint8)]
    rows = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(symbols)]
    for i in range(0, len(symbols), AT_ONCE):
        _add_grams(symbols, rows, i, min(i + AT_ONCE, len(symbols)), out)
    return out


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(texts: list[str | None]):
    """Row numbers and lower-cased bytes of the texts that are there, some 64 rows or AT_ONCE bytes at a time."""
    rows, block, size = [], [], 0
    for i, text in enumerate(texts):
        if text is not None:
            rows.append(i)
            block.append(text.lower().encode())
            size += len(block[-1])
        if len(rows) == 64 or size > AT_ONCE:
            yield rows, block
            rows, block, size = [], [], 0
    if rows:
        yield rows, block


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 500, clusters: int = 4, slack: float = 0.4, languages: int = 500) -> dict:
    """Centroids from labelled rows: about `per_language` texts of each language, chosen by a hash of the id.

    per_language bounds the sample, so that one language fits one task; languages, how many (the most frequent values)
    are learnt, so that the model (clusters * DIM numbers a language) fits the driver whatever the column holds: a text of
    a language beyond them gets the nearest learnt one, or is rejected as too far from all. Rows without a language or
    text are not used; repeated rows count as often as they come; very long texts count whole. slack: a text is rejected if its cosine is
    below slack times the lowest hundredth of the sample's. No usable rows give a model without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = written(counts, "languages")  # at most `languages` rows
    chosen = uniform(F.col("doc_id"), "language") < per_language / F.col("n")
    sample = written(rows.join(F.broadcast(counts), "lang").where(chosen).select("text", "lang"), "language-sample")

    def document_frequency(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, block in _blocks(batch.column("text").to_pylist()):
                seen += (gram_counts(block) > 0).sum(0)
                n += len(block)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *slots]), pa.array([n, *seen[slots]])], ["slot", "seen"])

    # summed by slot first, so that DIM + 1 numbers reach the driver however many tasks there are
    sums = {r["slot"]: r["seen"] for r in sample.mapInArrow(document_frequency, "slot long, seen long").groupBy("slot").agg(F.sum("seen").alias("seen")).collect()}
    n, seen = sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(DIM)])
    idf = np.log((1 + n) / (1 + seen)) + 1

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])
        x = np.vstack([_weighed(gram_counts(b), idf).astype(np.float32) for _, b in _blocks(texts)])
        centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
        for _ in range(10):
            near = (x @ centres.T).argmax(1)
            sums = np.array([x[near == k].sum(0) if (near == k).any() else centres[k] for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        near = (x @ centres.T).max(1)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": list(centres.astype(float)),
                             "least": slack * float(np.quantile(near, 0.01))})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>, least double").collect()
    found.sort(key=lambda r: (r["lang"], list(r["centre"])))
    return {"idf": idf, "langs": [r["lang"] for r in found], "least": np.array([r["least"] for r in found]),
            "centres": np.array([r["centre"] for r in found], np.float32).reshape(-1, DIM)}


def predicted(spark, text: Column, model: dict) -> Column:
    """A struct of lang_pred, score (cosine, 0 to 1) and rejected for each text.

    `und`, score 0 and rejected: a text that is null or has no letter, or a model without languages. Ties go to the
    first language in order. Every row is by itself; the broadcast model has a fixed size per language.
    """
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        import regex

        letter, m = regex.compile(r"\p{L}").search, shared.value
        texts = [t if t is not None and letter(t) else None for t in texts]
        langs, score, rejected = np.full(len(texts), UND, object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if m["langs"]:
            names = np.array(m["langs"], object)
            for rows, block in _blocks(texts):
                counts = gram_counts(block)
                near = _weighed(counts, m["idf"]).astype(np.float32) @ m["centres"].T
                least = m["least"] * np.sqrt(np.minimum(1, (counts > 0).sum(1, keepdims=True) / ENOUGH))
                best = near.argmax(1)
                cosine = near[np.arange(len(best)), best]
                langs[rows], score[rows], rejected[rows] = names[best], np.clip(cosine, 0, 1), cosine < least[np.arange(len(best)), best]
        return pd.DataFrame({"lang_pred": langs, "score": score, "rejected": rejected})

    return F.pandas_udf(predict, "lang_pred string, score double, rejected boolean")(text)


def remainder(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string")) % n


def learnt(docs: DataFrame) -> dict:
    """The model of the contract: learnt from documents whose crc32 remainder by 3 is not 1."""
    return fit(docs.where(remainder(F.col("doc_id"), 3) != 1))


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is not rejected, with all their columns."""
    judged = docs.withColumn("__p", predicted(docs.sparkSession, F.col("text"), learnt(docs)))
    return judged.where(~F.col("__p.rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, predicted(spark, F.col("text"), learnt(docs)).alias("p")).select(
        "doc_id", "held_out", "p.*")
