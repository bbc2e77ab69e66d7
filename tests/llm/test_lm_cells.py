"""The language model's cells: packed arrays, the same scores however many cells there are, and disk."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchspark.llm import pitman_yor, store
from patchspark.llm.packed import from_gaps, gaps, pack, unpack

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_packed_arrays_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    arrays = {"keys": gaps(keys), "none": np.zeros(0, int), "zeros": np.zeros(5), "n": np.arange(70_000), "most": np.full(1, 2**64 - 1, np.uint64)}
    got = unpack(pack(**arrays))
    assert list(got) == list(arrays) and all(np.array_equal(got[k], x) for k, x in arrays.items())
    assert np.array_equal(from_gaps(got["keys"]), keys)
    # high bytes that all are 0 take no room
    assert len(pack(n=np.random.default_rng(2).integers(0, 256, 10_000))) < 11_000


@pytest.mark.parametrize("wide", [False, True])
def test_tokens_are_counted_by_pair_and_text(wide):
    rng = np.random.default_rng(3)
    c, w, of = (rng.integers(0, 9, 2000) for _ in range(3))
    far = 1 << 40 if wide else 1  # numbers that don't fit one key are sorted one by one
    got = pitman_yor._counted(c * far, w * far, of)
    keys, n = np.unique(np.stack([c * far, w * far, of], 1), axis=0, return_counts=True)
    assert np.array_equal(np.stack(got, 1), np.column_stack([keys, n]))


def test_a_frequent_context_is_dealt_over_cells():
    word = np.sort(pitman_yor.mixed(np.arange(1, 4001, dtype=np.uint64)))
    said = np.stack([np.full(4000, word[7]), word], 1).ravel()  # one word before each of all words
    first = np.arange(8000) == 0
    cells = list(pitman_yor._by_cell(np.zeros(8000, np.int32), said, first, 4, True))
    pairs = {(c, w) for _, p in cells for c, w in zip(from_gaps(p["contexts"])[pitman_yor._contexts(p)].tolist(), from_gaps(p["words"])[p["w"]].tolist(), strict=True)}
    assert pairs == set(zip([pitman_yor.START, *said[:-1].tolist()], said.tolist(), strict=True))
    assert sum(int(p["n"].sum()) for _, p in cells) == 8000 and max(len(p["w"]) for _, p in cells) < 8000 / 3
    for cell, p in cells:
        assert set(pitman_yor.bucket(from_gaps(p["words"]), 4)) == {cell % 4} and set(pitman_yor.bucket(from_gaps(p["contexts"]), 4)) == {cell // 4}


def test_runs_that_came_apart_are_seen():
    head = pack(id=np.arange(2), tokens=np.ones(2), cells=np.array([2]), unit=np.array([34]))
    one = pack(of=gaps(np.array([0, 1])), known=np.ones(2), base=np.full(2, 2**33), score=np.full(2, 2**34))
    table = lambda *x: pa.table({"block": [1] * len(x), "data": pa.array(x, pa.binary())})
    got = pitman_yor._assembled(None, table(one, head, one)).to_pydict()
    assert got["base_score"] == [-1.0, -1.0] and got["score"] == [-2.0, -2.0] and got["n_known"] == [2, 2]
    with pytest.raises(RuntimeError, match="came apart"):
        pitman_yor._assembled(None, table(one, head))


def test_scores_take_little_disk_and_do_not_depend_on_the_cells(spark, monkeypatch):
    """A row for every pair and for every pair of a text took over 4 x the input of disk."""
    docs = spark.read.parquet(SMALL).select("doc_id", "text")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {f.getPath(): f.length() for f in map(every.apply, range(every.size()))}

    def scored():
        """(rows, cells a side, bytes of all tables that are left and of what scoring shuffles)"""
        folder = store.shared_dir(spark).removeprefix("file:")
        before = set(os.listdir(folder))
        model, m = pitman_yor.fit(docs.select("text"))
        held = files()
        rows = {r["doc_id"]: r for r in pitman_yor.score(docs, model, m).collect()}
        tables = sum(os.path.getsize(os.path.join(at, f)) for x in set(os.listdir(folder)) - before for at, _, names in os.walk(os.path.join(folder, x)) for f in names)
        return rows, m["side"], tables + sum(n for f, n in files().items() if f not in held)

    few, side, size = scored()
    given = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert size < 4 * given  # 3.1; it was 5.1
    assert side == 2
    monkeypatch.setattr(pitman_yor, "CELL", given / 20)
    many, side, _ = scored()
    assert side == 5 and len(many) == len(few)
    for i, r in few.items():
        assert many[i][:4] == r[:4] and many[i]["score"] == pytest.approx(r["score"], rel=1e-9) and many[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
