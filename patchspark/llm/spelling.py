"""Spelling variants: words of a corpus within one edit of a far more frequent word.

A word's letters with their occurrence numbers (the second t, the third t, ...) are a binary vector. Words of one length
that differ by one replaced letter have vectors two apart, words that differ by one inserted letter one apart. PartEnum
turns such a distance into equality: elements are dealt to first-level partitions, one of which holds no more than its
share of the difference, and each of these to second-level ones, of which all but so many are equal; every choice of
them is a signature. One edit also leaves the first or the last half of a word as it was, so each signature is taken with
either half: words meet in an equi-join on a signature that few others have, and are then compared. Groups of one
signature are small even where many words have the same letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchspark.llm.shingles import mixed
from patchspark.llm.store import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on; characters from which a text's words are not listed at once.
HELD, LONG = 400_000, 1 << 20
#: First- and second-level partitions for words of one length (distance 2), and for a word and a longer one (distance 1).
SAME, LONGER = (1, 4), (1, 3)
SAME_LENGTH, SHORTER, IS_LONGER = 2, 0, 1


def _spoiled(batches: Iterable[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes: A-Z alone
            runs = RUN.findall(lowered) if len(lowered) < LONG else (m[0] for m in RUN.finditer(lowered))
            start = zlib.crc32(b"" if id_ is None else b"%d" % id_)
            start = zlib.crc32(b":", start)
            for word, n in Counter(runs).items():
                if len(word) < least:
                    continue
                if every:
                    h = zlib.crc32(word.encode(), start)
                    if not h % every:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < least:
                            continue
                total[word] = total.get(word, 0) + n
            if len(total) > HELD:
                yield rows()
                total = {}
    if total:
        yield rows()


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, spoil_every: int = 0) -> DataFrame:
    """(word, n): runs of Latin letters in whole texts, A-Z lower-cased, of so many code points and occurrences at least.

    spoil_every plants variants: with h the crc32 of `<id>:<run>`, a run whose h it divides loses the code point h % length.
    A null text has no runs, a null id counts as empty; rows that share an id are spoiled alike. Words are added up by task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(lambda b: _spoiled(b, min_chars, spoil_every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def partenum(vectors: np.ndarray, of: np.ndarray, n: int, k: int, n1: int, n2: int) -> np.ndarray:
    """Signatures (n rows) of n sets of 64-bit elements: those whose sets differ in at most k elements share one.

    Of the n1 first-level partitions one has at most (k + 1) // n1 - 1 of the differences, rounded up, and so many of its n2 parts
    at most differ: the rest, in every choice, is a signature.
    """
    differ = -(-(k + 1) // n1) - 1
    if not 0 <= differ < n2:
        raise ValueError(f"no signatures for distance {k} with {n1} and {n2} partitions")
    part = (mixed(vectors + np.uint64(k)) % np.uint64(n1 * n2)).astype(np.int64)
    at = of * (n1 * n2) + part
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
    sums = np.zeros(n * n1 * n2, np.uint64)
    if len(order):
        sums[at[order][begins]] = np.add.reduceat(mixed(vectors[order] ^ np.uint64(0xA5A5A5A5)), begins)
    sums, out = sums.reshape(n, n1, n2), []
    for i in range(n1):
        for kept in combinations(range(n2), n2 - differ):
            seed = np.uint64(1 + len(out))
            signature = np.full(n, seed, np.uint64)
            for j in kept:
                signature = mixed(signature + sums[:, i, j])
            out.append(signature)
    return np.stack(out, axis=1)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, word number, element): an element is a letter with its occurrence number in the word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    order = np.lexsort((codes, of))
    key = of[order] * (1 << 21) + codes[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - first[np.cumsum(new) - 1]
    return codes, of, mixed((codes << 32 | nth).view(np.uint64))


def _halves(codes: np.ndarray, of: np.ndarray, sizes: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last `half` code points of each word."""
    at = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[of]
    power = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    begins = np.cumsum(sizes) - sizes
    value = (codes + 1).view(np.uint64)
    add = lambda keep, place: np.add.reduceat(np.where(keep, value * power[place], np.uint64(0)), begins)
    return mixed(add(at < half[of], at)), mixed(add(at >= (sizes - half)[of], sizes[of] - 1 - at) + np.uint64(1))


def signatures(words: list[str]) -> list[tuple[int, np.ndarray]]:
    """(side, keys of each word): words of one length one edit apart share a key of SAME_LENGTH, others one of SHORTER and IS_LONGER."""
    codes, of, elements = letters(words)
    sizes = np.array([len(w) for w in words], np.int64)
    same, longer = partenum(elements, of, len(words), 2, *SAME), partenum(elements, of, len(words), 1, *LONGER)
    out = []
    for side, signature, size, kind in ((SAME_LENGTH, same, sizes, 1), (SHORTER, longer, sizes, 2), (IS_LONGER, longer, sizes - 1, 2)):
        tag = mixed((size * 4 + kind).view(np.uint64))  # the length of the shorter word: both must agree on it
        keys = [mixed(signature + (h + tag)[:, None]) for h in _halves(codes, of, sizes, size // 2)]
        out.append((side, np.hstack(keys)))
    return out


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        for side, keys in signatures(batch.column("word").to_pylist()):
            place = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.full(keys.size, side, np.int32)), batch.column("word").take(place), batch.column("n").take(place)],
                                             ["key", "side", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of words (word, n) that differ by exactly one inserted, deleted or replaced code point, each once."""
    signed = words.where(F.length("word") > 0).mapInArrow(_signed, "key long, side int, word string, n long")
    a = signed.where(F.col("side") != IS_LONGER).select("key", "side", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = signed.where(F.col("side") != SHORTER).select("key", F.col("side").alias("b_side"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    fits = ((F.col("side") == SHORTER) & (F.col("b_side") == IS_LONGER)) | ((F.col("side") == SAME_LENGTH) & (F.col("b_side") == SAME_LENGTH) & (F.col("a") < F.col("b")))
    # signatures are many times what Spark takes the words for, so neither side is to be broadcast
    met = a.join(b.hint("merge"), "key").where(fits & (F.levenshtein("a", "b", 1) == 1))
    # a word alone has at most one edit from the empty one
    return met.select("a", "a_n", "b", "b_n").distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of words (word, n), whose words are distinct.

    form is the near word of largest n (ties: the first in code-point order) if its n is at least ratio times the word's
    own, else null; root is where the forms of forms end, the word itself if it has no form. Counts grow along forms, so
    there are no cycles, and the ways double each round. A null word is near to none.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could run in circles")
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = written(near_words(words), "near-words")
    both = near.unionAll(near.select("b", "b_n", "a", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"), F.first("a_n").alias("own"))
    has = -F.col("best.less") >= ratio * F.col("own")
    forms = written(best.select("word", "n_near", F.when(has, F.col("best.b")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    ways = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(ways.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    out = words.join(forms.hint("merge"), "word", "left").join(ways.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), spoil_every=199))
