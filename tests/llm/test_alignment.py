"""Alignment of two tokenizers against a plain walk over both token lists."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patchspark.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t = alignment.Tokenizers(*alignment.default_tokenizers())

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(t.a_bytes[i] for i in x) == (" " + text).encode() == b"".join(t.b_bytes[i] for i in y):
            return []
        out, ends = [], [0, 0]
        x, y, one, two = x[::-1], y[::-1], [], []
        while x or y:
            if ends[0] <= ends[1]:
                one.append(x.pop())
                ends[0] += len(t.a_bytes[one[-1]])
            else:
                two.append(y.pop())
                ends[1] += len(t.b_bytes[two[-1]])
            if ends[0] == ends[1]:
                out.append((one, two))
                one, two = [], []
        return out

    return groups


def expected(groups, rows):
    of = [(i, groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in of]
    count, most = Counter(p for own in links for p in own), defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, g), own in zip(of, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


ODD = [(1, "Hello  world, naïve 日本語 text.\n\n  Tabs\tand <|endoftext|> <s> 😀 it's 12345"), (2, None), (3, ""), (4, "a ▁ b"), (5, " "), (5, "  lead and trail  "), (None, "same text"), (None, "same text"), (6, "é" * 40),
       (7, "\x00\x1c \x1d x　y  z\xa0 q"), (8, "x y z " * 3000), (9, "word" * 4000), (10, "'s 't I'll don 't"), (11, "▁"), (12, "good " * 2000 + "▁")]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_rows(spark, brute, monkeypatch, small):
    if small:  # many blocks, rows and slices
        for name, n in (("AT_ONCE", 500), ("BLOCK_ENTRIES", 300), ("ROW_PAIRS", 7), ("ROW_TEXTS", 2), ("KEPT_CHUNKS", 20)):
            monkeypatch.setattr(alignment, name, n)
        monkeypatch.setattr(alignment.slices, "__defaults__", (500,))
    rows = ODD + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    if small:  # in this process, as monkeypatch does not reach workers
        import pyarrow as pa

        names, kind = ["block", "pairs", "docs", "texts", "data"], pa.list_(pa.struct([("id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("sha", pa.string()), ("groups", pa.null())]))
        batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
        made = list(alignment._aligned([batch.slice(0, 20), batch.slice(20)], alignment.default_tokenizers(), 3, names, kind, False))
        blocks, count = defaultdict(lambda: [[], []]), Counter()
        for r in (r for b in made for r in b.to_pylist()):
            blocks[r["block"]][0] += r["pairs"]
            blocks[r["block"]][1].append(r)
            count.update(dict(zip(r["pairs"], r["docs"], strict=True)))
        got = []
        for pairs, parts in blocks.values():
            assert pairs == sorted(set(pairs))
            for r in parts:
                of, place, times = alignment._unpacked(r["data"], len(r["texts"]))
                for k, t in enumerate(r["texts"]):
                    got.append((t["id"], t["n_a"], t["n_b"], t["n_groups"], t["n_links"], int(sum(count[pairs[p]] * n for o, p, n in zip(of, place, times, strict=True) if o == k)), t["sha"]))
        assert len(blocks) > 3 and sorted(got, key=str) == sorted(((*r[:5], *r[6:]) for r in expected(brute, rows)), key=str)
        return
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, groups string").repartition(3)
    got = alignment.aligned(df).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == expected(brute, rows)
    for r in got:
        ends = [g["end"] for g in r["groups"]]
        assert [g["start"] for g in r["groups"]] == [0, *ends[:-1]][: len(ends)] and sum(len(g["a"]) for g in r["groups"]) == r["n_a"]
        text = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in r["groups"])
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert alignment.aligned(df.limit(0), with_groups=False).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Zé日😀\n\t'\x00\x1c\xa0.1▁<s>"), max_size=30))
def test_chunks_are_encoded_as_in_the_text(brute, text):
    chunks = alignment._chunks(*alignment.default_tokenizers())
    if text:
        numbers = chunks.numbers(alignment.SAFE.split(text))
        got = ";".join(chunks.text[i] for i in numbers) if all(chunks.ok[i] for i in numbers) else ""
        assert got == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute(text))


def test_coalescing():
    g = alignment.coalesced(*(np.array(x) for x in ([0, 3, 5, 6], [3, 5, 6, 9], [0, 1, 5, 7], [1, 5, 7, 9])))
    assert g.a.tolist() == [0, 0, 1, 1] and g.b.tolist() == [0, 0, 1, 1] and g.n == 2
