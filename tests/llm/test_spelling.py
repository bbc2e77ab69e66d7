"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchspark.llm import spelling

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every=199):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(words, ratio=5):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def test_spelling_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(brute_words([tuple(r) for r in docs.select("doc_id", "text").collect()], 7))
    got = sorted(tuple(r) for r in spelling.variants(spelling.counted_words(docs, spoil_every=7)).collect())
    assert got == want and any(w[1] for w in want)


def test_spelling_odd_rows(spark):
    words = ["letters", "lettters", "leters", "etters", "lettersx", "lettérs", "×÷Àÿ×÷", "abcdef", "abcdeg", "bacdef", "aaaaaa", "aaaaaaa", "aaaaab", "abcabc" * 3000]
    times = [400, 9, 40, 5, 30, 6, 5, 50, 50, 5, 700, 100, 5, 5]
    text = " ".join(w.upper() if w.isascii() else w for w, n in zip(words, times, strict=True) for _ in range(n))
    rows = [(1, text, "x"), (None, "LETTERS letterz, letterz.letterz\tletterz'letterz", "y"), (2, None, "z"), (3, "", "z"), (1, text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    for every in (199, 2):
        want = brute(brute_words([r[:2] for r in rows], every))
        assert sorted(tuple(r) for r in spelling.variants(spelling.counted_words(docs, spoil_every=every)).collect()) == want
    assert spelling.variants(spelling.counted_words(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, 1)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=1, max_size=9), st.integers(0, 9), st.sampled_from("abd"), st.integers(0, 2))
def test_one_edit_shares_a_signature(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = word[:at] + ("" if kind == 0 else letter) + word[at + (kind != 1) :]
    if other == word or not other:
        return
    a, b = sorted((word, other), key=len)
    keys = dict(spelling.signatures([a, b]))
    sides = (spelling.SAME_LENGTH, spelling.SAME_LENGTH) if len(a) == len(b) else (spelling.SHORTER, spelling.IS_LONGER)
    assert set(keys[sides[0]][0]) & set(keys[sides[1]][1])


@pytest.mark.parametrize(("k", "n1", "n2"), [(2, 1, 4), (2, 2, 3), (2, 3, 1), (1, 1, 3), (5, 2, 4)])
def test_partenum_loses_no_pair(k, n1, n2):
    r = np.random.default_rng(k + n1)
    for _ in range(200):
        base = set(r.integers(0, 60, 20).tolist())
        other = base ^ set(r.choice(60, k, replace=False).tolist())
        sets = [sorted(base), sorted(other)]
        s = spelling.partenum(np.concatenate(sets).astype(np.uint64), np.repeat([0, 1], [len(x) for x in sets]), 2, k, n1, n2)
        assert (s[0] == s[1]).any()
    with pytest.raises(ValueError):
        spelling.partenum(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 2, 1, 2)


def test_no_side_is_broadcast(spark):
    """Spark takes what mapInArrow() gives to be as small as the words, and the words for what their files are."""
    words = spark.createDataFrame([("banana", 9), ("banane", 1), ("bananas", 1)], "word string, n long")
    for df in (spelling.near_words(words), spelling.variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
