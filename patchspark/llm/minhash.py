"""Near-duplicates by SuperMinHash signatures, banding, verification on full shingle sets, and components.

Each shingle deals out ranks 0, 1, 2, ... to the registers in a random order of its own (Fisher-Yates) and a random
fraction with each rank; a register keeps the smallest rank + fraction. As the ranks of one shingle differ from register
to register, the signature varies less than with independent hashes; a shingle stops as soon as its next rank can't
improve any register of its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchspark.llm.components import connected_components
from patchspark.llm.shingles import blocks, mixed, shingle_sets
from patchspark.llm.store import written

REGISTERS, BANDS = 128, 32
#: Rows that are taken out of an Arrow batch together.
AT_ONCE = 512
#: Fraction bits below a register's rank.
_BITS = 25


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS numbers (rank and fraction in one) for each set; rows of empty sets are all ones."""
    m, sig = REGISTERS, np.full((len(sets), REGISTERS), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    element = np.concatenate([np.zeros(0, np.uint64), *sets])
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
    for j in range(m):
        if not len(element):
            break
        draw = mixed(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(element))
        register = order[rows, k]
        order[rows, k] = order[:, j]
        np.minimum.at(flat, of * m + register, (j << _BITS | (draw & np.uint64((1 << _BITS) - 1)).astype(np.int64)).astype(np.uint32))
        goes_on = (sig.max(1) >> _BITS > j)[of]
        if not goes_on.all():
            element, of, order = element[goes_on], of[goes_on], order[goes_on]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band: the band's registers and its number."""
    parts = sig.reshape(len(sig), BANDS, -1).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(33)
    for i in range(parts.shape[2]):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def _signed(batches, k: int):
    parts = (batch.slice(start, AT_ONCE) for batch in batches for start in range(0, batch.num_rows, AT_ONCE))
    for part in parts:
        ids = part.column("doc_id")
        for first, block in blocks(part.column("text").to_pylist()):
            sets = shingle_sets(block, k)
            sig = superminhash(sets)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, len(block)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                pa.array([row.tobytes() if f else None for row, f in zip(sig, full, strict=True)], pa.binary()),
                pa.array([row if f else None for row, f in zip(band_keys(sig), full, strict=True)], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "same", "sig", "bands"])


def _linked(batches, percent: int, k: int):
    """The pairs (a, b, text_a, text_b) with 100 * intersection >= percent * union of the texts' full shingle sets."""
    known, last = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            out = []
            for x, y in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                if y != known or last is None:
                    known, last = y, shingle_sets([(y or "").encode()], k)[0]
                mine = shingle_sets([(x or "").encode()], k)[0]
                both = len(np.intersect1d(mine, last, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(mine) + len(last) - both))
            yield part.select(["a", "b"]).filter(pa.array(out, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int, part: int = 256) -> DataFrame:
    """The pairs (a, b) whose texts are linked. A b with many pairs is dealt out in parts of about `part`, its text to each."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int")).drop("parts")
    with_a = dealt.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    leads = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(parts, "b").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = with_a.join(leads, ["b", "part"]).select("a", "b", "text_a", "text_b")
    return written(pairs.mapInArrow(lambda batches: _linked(batches, percent, k), "a long, b long"), "links")


def _across(frames, percent: int, k: int):
    """Links between different components of a bucket's block, as many as it takes to join them.

    Rows come sorted by (key, i, j); a block is carried over to the next batch until it is complete.
    """
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = held[["key", "i", "j"]].iloc[-1]
        open_rows = (held[["key", "i", "j"]] == last).all(axis=1).to_numpy()
        yield _block_links(held[~open_rows], percent, k)
        held = held[open_rows]
    if held is not None:
        yield _block_links(held, percent, k)


def _block_links(frame: pd.DataFrame, percent: int, k: int) -> pd.DataFrame:
    found: list[tuple[int, int]] = []
    for (_, i, j), block in frame.groupby(["key", "i", "j"], sort=False):
        sig = np.frombuffer(b"".join(block["sig"]), np.uint32).reshape(len(block), -1)
        ids, comps, parts, texts, band = (block[c].to_numpy() for c in ("id", "comp", "part", "text", "band"))
        sets: dict[int, np.ndarray] = {}

        def shingles(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = shingle_sets([(texts[r] or "").encode()], k)[0]
            return sets[r]

        for r in range(len(block) - 1):
            equal = sig[r + 1 :] == sig[r]
            # a link's signatures agree in percent/100 of the registers, give or take 0.04: 5 times that is allowed
            near = (equal.mean(1) >= percent / 100 - 0.2) & ((parts[r + 1 :] != parts[r]) | (i == j))
            at = np.flatnonzero(near)
            # two rows that meet in several bands are compared in the first of them
            at = r + 1 + at[equal[at].reshape(len(at), BANDS, REGISTERS // BANDS).all(2).argmax(1) == band[0]]
            for s in at:
                if comps[s] != comps[r]:
                    x, y = shingles(r), shingles(s)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((max(ids[r], ids[s]), min(ids[r], ids[s])))
                        comps = np.where(comps == comps[s], comps[r], comps)
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 75, block: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents whose sets of k-word shingles have 100 * intersection >= percent * union are linked. Texts with one and
    the same set are one node, its smallest doc_id. In each band bucket every node is verified against the bucket's
    smallest id, which settles buckets of near copies without listing their pairs. Only in buckets that stay in
    several components the members of different components are compared too, in blocks of `block` rows: by signature
    first (agreement five deviations below what a link has, which loses about one link in ten million), then on full sets,
    until they are joined. Else links are lost only where no band agrees: with 32 bands of 4 registers in 5 of a million
    pairs at similarity 0.75, fewer above.
    Defined cases: texts without words (null, empty) have n_shingles 0 and are linked with nothing; rows that share a
    doc_id are one node; a row without doc_id is kept as its own component (null); no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(lambda b: _signed(b, k), "doc_id long, n_shingles long, same binary, sig binary, bands array<long>"), "signatures")
    nodes = signed.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("id"))
    nodes = written(nodes, "nodes")
    ids = nodes.select("id").distinct()
    own = signed.join(ids, signed["doc_id"] == ids["id"], "left_semi").where("same is not null")
    banded = written(own.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key")), "bands")
    shared = written(banded.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    starred = banded.join(shared, "key").where("id <> lead")
    texts = rows.join(ids, rows["doc_id"] == ids["id"], "left_semi")
    links = _confirmed(starred.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), texts, percent, k)
    comps = connected_components(links)
    labelled = banded.join(shared, "key").join(comps, "id", "left").select(
        "key", "band", "id", "members", F.coalesce("component", "id").alias("comp"))
    labelled = written(labelled, "labelled")
    split = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    parts = F.ceil(F.col("members") / block).cast("int")
    open_rows = labelled.join(split, "key").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    open_rows = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "key", "band", "id", "comp", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    sigs = own.select(F.col("doc_id").alias("id"), "sig")
    open_rows = open_rows.join(sigs, "id").join(texts.withColumnRenamed("doc_id", "id"), "id")
    open_rows = open_rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = written(open_rows.mapInPandas(lambda f: _across(f, percent, k), "a long, b long"), "links")
    comps = connected_components(links.unionAll(more))
    roots = written(nodes.join(comps, "id", "left").select("same", F.coalesce("component", "id").alias("component")), "roots")
    joined = signed.join(roots, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns."""
    stay = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["__id"]), "left_semi")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Pairs that share a shingle, and all that is reachable by links: for tables of some thousand documents.
OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM sets UNION SELECT id, b FROM reach JOIN both_ways ON r = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept FROM sets JOIN (SELECT id, min(r) AS low FROM reach GROUP BY 1) ON doc_id = id
"""
