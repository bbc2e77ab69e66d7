"""Alignment of two tokenizers' tokens over the same bytes, and the counts of linked id pairs in a corpus.

Tokens are intervals of bytes. Sorted by start, with the running maximum of their ends, a group breaks where a start
reaches that maximum: there both tokenizers end a token. Within a group all A tokens are linked with all B tokens.

Between two words that a single space parts, both tokenizers always break (A's pattern takes the space to the word behind
it, no piece of B has a space after its first letter), so texts are cut there, each different chunk is encoded and
coalesced once in a batch of many, and texts of any length go slice by slice. Corpus counts: a task packs its texts' pairs
as numbers of a block's own list of pairs; the lists are counted by pair in a shuffle, and the counts go back to the
blocks. A block is bounded, so neither a frequent pair nor a long text makes a large group.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchspark.llm.store import written

#: Where both tokenizers break: a single space between two characters that are no white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Runs without a space that are left to the encoder by merges, as the one by ranks takes long for them.
LONG_RUN, LONG_WORD = 1000, re.compile(r"\S{1000}|\s{1000}")
#: Characters of texts that are taken together, and that the kept chunks may have before they are forgotten; kept chunks.
AT_ONCE, KEPT_CHARS, KEPT_CHUNKS = 1 << 20, 4_000_000, 250_000
#: Pairs of texts, and different pairs, from which on a block is closed; pairs and texts of one of its rows.
BLOCK_ENTRIES, BLOCK_PAIRS, ROW_PAIRS, ROW_TEXTS = 3_000_000, 500_000, 16_384, 1024
DIGEST = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("n_best", "long"), ("count_sum", "long"), ("groups_sha256", "string")]


class Groups(NamedTuple):
    """Group of each A and each B token, and the number of groups."""

    a: np.ndarray
    b: np.ndarray
    n: int


def coalesced(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> Groups:
    """Groups of the tokens of two tilings, in order: a group ends where a start reaches all ends before it."""
    start, end = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    if not len(start):
        return Groups(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    number = np.concatenate([[0], np.cumsum(start[order][1:] >= reach[:-1])])
    of = np.empty(len(start), np.int64)
    of[order] = number
    return Groups(of[: len(a_starts)], of[len(a_starts) :], int(number[-1]) + 1)


def _ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... (counts[0] of them), firsts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - counts), counts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts[order], begins) if len(begins) else counts[:0]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = byte_level()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if i in special else bytes(map(byte.__getitem__, token))
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))

        self.ranked = self._by_rank(json.loads(a_json), byte)
        # a number with what may follow it: another token of its side, the other side, another group, another chunk
        self.a_text, self.b_text = ([f"{i}{end}" for end in ",|;\n" for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.both_text = self.a_text + self.b_text

    def _by_rank(self, made: dict, byte: dict[str, int]) -> Callable[[str], list[int]] | None:
        """The same encoder by ranks, which is several times faster, if ids follow the order of merges and the split is the plain byte-level one."""
        import public_tokenizers
        import tiktoken

        split = made["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        ids = [self.a.token_to_id("".join(m)) for m in merges]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or made["normalizer"] or made["model"].get("ignore_merges") or any(i is None for i in ids) or ids != sorted(ids):
            return None
        special = set(self.a.get_added_tokens_decoder())
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.a.get_vocab().items() if i not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of space + text, and B's ids of text, which puts the space itself."""
        if self.ranked and max(map(len, texts), default=0) < LONG_RUN or self.ranked and not LONG_WORD.search("\n".join(texts)):
            a = [self.ranked(" " + t) for t in texts]
        else:
            a = [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """(A ids, their number by chunk, B ids, their number by chunk) of space + chunk; a chunk that is not given back has none."""
        raw = [(" " + c).encode() for c in chunks]
        ends, out = np.cumsum(list(map(len, raw))), []
        if not any(c[0].isspace() or c[-1].isspace() for c in chunks):
            # side by side they are a text with safe cuts, encoded at once
            for ids, of, size in zip(self._both([" ".join(chunks)]), (self.a_bytes, self.b_bytes), (self.a_size, self.b_size), strict=True):
                if b"".join(map(of.__getitem__, ids[0])) == b"".join(raw):
                    ids = np.array(ids[0], np.int64)
                    out += [ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends, "right"), prepend=0)]
            if len(out) == 4:
                return tuple(out)
        a, b = self._both(chunks)
        for i, r in enumerate(raw):
            if not b"".join(map(self.a_bytes.__getitem__, a[i])) == r == b"".join(map(self.b_bytes.__getitem__, b[i])):
                a[i], b[i] = [], []
        return tuple(x for ids in (a, b) for x in (np.fromiter(chain.from_iterable(ids), np.int64), np.array(list(map(len, ids)), np.int64)))


class Chunks:
    """Different chunks of texts with their aligned tokens; numbers count up until forget()."""

    def __init__(self, tokenizers: Tokenizers):
        self.t, self.base, self.with_groups = tokenizers, len(tokenizers.b_bytes), False
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.ok, self.text, self.sizes = 0, [], [], []
        self.counts = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, distinct pairs
        self.first = np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; unknown ones are encoded and coalesced together."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        edged = [c for c in new if c[0].isspace() or c[-1].isspace() or "▁" in c]
        if edged:
            apart = set(edged)
            new = [c for c in new if c not in apart]
        for some in (new, edged):
            for cut in range(0, len(some), 8192):
                self._add(some[cut : cut + 8192])
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def _add(self, new: list[str]) -> None:
        a_ids, a_many, b_ids, b_many = self.t.encode(new)
        n = len(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + n)))
        self.ok += (a_many > 0).tolist()
        self.chars += sum(map(len, new))
        a_of, b_of = np.repeat(np.arange(n), a_many), np.repeat(np.arange(n), b_many)
        a_end, b_end = np.cumsum(self.t.a_size[a_ids]), np.cumsum(self.t.b_size[b_ids])  # the chunks side by side
        g = coalesced(a_end - self.t.a_size[a_ids], a_end, b_end - self.t.b_size[b_ids], b_end)
        chunk_of = np.zeros(g.n, np.int64)
        chunk_of[g.a] = a_of
        # all pairs of a group, from its distinct ids and how often each stands in it
        a_key, a_n = _summed(g.a * len(self.t.a_bytes) + a_ids, np.ones(len(a_ids), np.int64))
        b_key, b_n = _summed(g.b * self.base + b_ids, np.ones(len(b_ids), np.int64))
        a_group, b_group = a_key // len(self.t.a_bytes), b_key // self.base
        b_first, many = np.searchsorted(b_group, np.arange(g.n)), np.bincount(b_group, minlength=g.n)
        many = many[a_group]
        other = _ragged(b_first[a_group], many)
        pair = np.repeat(a_key % len(self.t.a_bytes), many) * self.base + b_key[other] % self.base
        own = chunk_of[np.repeat(a_group, many)]
        order = np.lexsort((pair, own))
        own, pair, times = own[order], pair[order], (np.repeat(a_n, many) * b_n[other])[order]
        begins = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])])) if len(pair) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, begins) if len(begins) else times
        own, pair = own[begins], pair[begins]
        links = np.bincount(own, weights=times, minlength=n).astype(np.int64)
        distinct = np.bincount(own, minlength=n)
        counts = np.stack([np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n), np.bincount(chunk_of, minlength=n), links, distinct], axis=1)
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(distinct) - distinct])
        self.counts = np.concatenate([self.counts, counts])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
        # the groups as text: a1,a2|b1,b2;...
        group, side = np.concatenate([g.a, g.b]), np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.lexsort((side, group))
        group, side, ids = group[order], side[order], np.concatenate([a_ids, b_ids])[order]
        end = np.full(len(ids), 3)
        end[:-1] = np.where(group[1:] == group[:-1], side[1:] - side[:-1], np.where(chunk_of[group[1:]] == chunk_of[group[:-1]], 2, 3)) if len(ids) else 3
        texts = iter("".join(map(self.t.both_text.__getitem__, (end * np.where(side, self.base, len(self.t.a_bytes)) + ids + side * len(self.t.a_text)).tolist())).split("\n"))
        self.text += [next(texts) if ok else "" for ok in self.ok[-n:]]
        if self.with_groups:
            sizes, cut = np.zeros(g.n, np.int64), np.searchsorted(chunk_of, np.arange(n + 1)).tolist()
            np.add.at(sizes, g.a, self.t.a_size[a_ids])
            self.sizes += [sizes[cut[i] : cut[i + 1]].tolist() for i in range(n)]

    def of_pairs(self, numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, how often) of the links of chunks that come `times` times each."""
        many = self.counts[numbers, 4]
        at = _ragged(self.first[numbers], many)
        return np.repeat(np.arange(len(numbers)), many), self.pairs[at], self.times[at] * np.repeat(times, many)


@lru_cache(1)
def _chunks(a_json: bytes, b_model: bytes) -> Chunks:
    return Chunks(Tokenizers(a_json, b_model))


def default_tokenizers() -> tuple[bytes, bytes]:
    """The bytes of the 50k byte-level file (A) and of the 32k piece model (B)."""
    import public_tokenizers

    return tuple(open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def slices(text: str, size: int = AT_ONCE) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut at safe spaces, which are left out."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class _Block:
    """Texts of a block with their pairs, until it is written."""

    def __init__(self) -> None:
        self.texts: list[tuple] = []
        self.of: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bad: list[int] = []
        self.entries, self.known = 0, np.zeros(0, np.int64)

    def full(self) -> bool:
        return self.entries > BLOCK_ENTRIES or len(self.known) > BLOCK_PAIRS

    def add(self, of: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        self.of.append(of.astype(np.int32))
        self.pair.append(pair)
        self.times.append(times.astype(np.int32) if not len(times) or times.max() < 2**31 else times)
        self.entries += len(pair)
        self.known = np.union1d(self.known, pair)

    def rows(self, number: int, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        of, pair, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.of, self.pair, self.times))
        if self.bad:
            keep = ~np.isin(of, self.bad)
            of, pair, times = of[keep], pair[keep], times[keep]
            self.known = np.unique(pair)
        place = np.searchsorted(self.known, pair)
        keys, times = _summed(of.astype(np.int64) << 32 | place, times.astype(np.int64))
        of, place = keys >> 32, keys & 0xFFFFFFFF
        step = place.copy()
        step[1:] -= np.where(of[1:] == of[:-1], place[:-1], 0)
        n, docs = len(self.texts), np.bincount(place, minlength=len(self.known))
        cut = np.searchsorted(of, np.arange(n + 1))
        for i in range(max(1, -(-n // ROW_TEXTS), -(-len(self.known) // ROW_PAIRS))):
            a, b = slice(i * ROW_PAIRS, (i + 1) * ROW_PAIRS), slice(min(n, i * ROW_TEXTS), min(n, (i + 1) * ROW_TEXTS))
            part = slice(cut[b.start], cut[b.stop])
            data = zlib.compress(np.diff(cut[b.start : b.stop + 1]).astype(np.uint32).tobytes() + _planes(step[part]) + _planes(times[part]), 1)
            texts = [dict(zip(["id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups"], t, strict=True)) for t in self.texts[b]]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([self.known[a]], pa.list_(pa.int64())), pa.array([docs[a]], pa.list_(pa.int64())),
                                              pa.array([texts], kind), pa.array([data], pa.binary())], names)


def _planes(x: np.ndarray) -> bytes:
    """Numbers of at most 64 bits, all first bytes before all second ones."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8).T).tobytes()


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the block's pairs, times) of the pairs of n texts."""
    raw = zlib.decompress(data)
    many = np.frombuffer(raw[: 4 * n], np.uint32).astype(np.int64)
    step, times = (np.ascontiguousarray(x.T).view("<u8").ravel().astype(np.int64) for x in np.frombuffer(raw[4 * n :], np.uint8).reshape(2, 8, -1))
    begin = np.cumsum(many) - many
    total = np.cumsum(step)
    before = np.repeat((total - step)[np.minimum(begin, max(0, len(step) - 1))] if len(step) else np.zeros(n, np.int64), many)
    return np.repeat(np.arange(n), many), total - before, times


def _aligned(batches: Iterable[pa.RecordBatch], files: tuple[bytes, bytes], partition: int, names: list[str], kind: pa.DataType, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """Rows of blocks: a slice of the block's pairs with the number of its texts that hold each, and some texts with their pairs."""
    chunks, block, number = _chunks(*files), _Block(), partition << 32
    if chunks.with_groups != with_groups:
        chunks.with_groups = with_groups
        chunks.forget()
    waiting: list[tuple[int, list[str], bool]] = []  # id, chunks of a slice, whether it is the text's last
    held, open_text = 0, None

    def settle() -> None:
        """What waits is counted; a text is entered in the block with its last slice."""
        nonlocal held, open_text
        numbers = chunks.numbers([c for _, cs, _ in waiting for c in cs])
        cut = np.cumsum([0, *(len(cs) for _, cs, _ in waiting)])
        of = np.repeat(np.arange(len(waiting)), np.diff(cut))
        row, chunk = np.divmod((keyed := _summed(of * (len(chunks.number) + 1) + numbers, np.ones(len(numbers), np.int64)))[0], len(chunks.number) + 1)
        sums = np.zeros((len(waiting), 5), np.int64)
        np.add.at(sums, row, chunks.counts[chunk] * keyed[1][:, None])
        good = np.ones(len(waiting), bool)
        good[row[~np.array(chunks.ok, bool)[chunk]]] = False
        entry, pair, often = chunks.of_pairs(chunk, keyed[1])
        text_of = np.empty(len(waiting), np.int64)
        for i, (id_, _, last) in enumerate(waiting):
            text_of[i] = len(block.texts)
            now = open_text = open_text or _Text()
            now.counts += sums[i, :4]
            now.ok &= bool(good[i])
            if now.ok and cut[i] < cut[i + 1]:
                own = numbers[cut[i] : cut[i + 1]].tolist()
                text = ";".join(map(chunks.text.__getitem__, own))
                now.digest.update(((";" if now.begun else "") + text).encode())
                now.begun = True
                if with_groups:
                    now.groups += zip(text.split(";"), (s for k in own for s in chunks.sizes[k]), strict=True)
            if last:
                if not now.ok:
                    block.bad.append(len(block.texts))
                is_set = now.ok and now.begun
                block.texts.append((id_, *(now.counts.tolist() if is_set else (0,) * 4), now.digest.hexdigest() if is_set else "",
                                    (_spans(now.groups) if is_set else []) if with_groups else None))
                open_text = None
        block.add(text_of[row[entry]], pair, often)
        waiting.clear()
        held = 0
        if chunks.chars > KEPT_CHARS or len(chunks.number) > KEPT_CHUNKS:
            chunks.forget()

    for batch in batches:
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            pieces = list(slices(text)) if text else [""]
            for piece in pieces[:-1]:
                waiting.append((id_, SAFE.split(piece), False))
                settle()
            waiting.append((id_, SAFE.split(pieces[-1]) if text else [], True))
            held += len(pieces[-1]) + 64
            if held > AT_ONCE:
                settle()
                if block.full():
                    yield from block.rows(number, names, kind)
                    block, number = _Block(), number + 1
    if waiting:
        settle()
    if block.texts:
        yield from block.rows(number, names, kind)


class _Text:
    """Sums over the slices of one text so far."""

    def __init__(self) -> None:
        self.counts, self.digest, self.ok, self.begun, self.groups = np.zeros(4, np.int64), hashlib.sha256(), True, False, []


def _spans(groups: list[tuple[str, int]]) -> list[dict]:
    """Groups with the bytes they cover, counted in space + text."""
    out, at = [], 0
    for text, size in groups:
        a, b = text.split("|")
        out.append({"start": at, "end": at + size, "a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))})
        at += size
    return out


SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("a", T.ArrayType(T.IntegerType())).add("b", T.ArrayType(T.IntegerType())))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[bytes, bytes] | None = None, with_groups: bool = True) -> DataFrame:
    """Counts, digest and groups of each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and
    groups (start, end, a, b; bytes of space + text) if asked for.

    tokenizers: the bytes of a byte-level file (A) and of a piece model whose pieces have spaces in front only (B). A pair's count is
    the number of rows of docs that hold it linked. Defined cases: null and empty texts, and texts whose bytes a tokenizer does not give
    back, have zeros, no groups and an empty digest, and count nowhere; equal rows count as often as they come; rows are told
    apart by place, so shared and null ids don't matter; texts of any length go in slices; no rows give no rows; columns
    that are not named are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizers or default_tokenizers())
    fields = T.StructType().add("id", "long").add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("sha", "string").add("groups", SPANS)
    schema = T.StructType().add("block", "long").add("pairs", T.ArrayType(T.LongType())).add("docs", T.ArrayType(T.LongType())).add("texts", T.ArrayType(fields)).add("data", "binary")
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["texts"].dataType)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _aligned(batches, shared.value, TaskContext.get().partitionId(), schema.names, kind, with_groups)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = written(rows.mapInArrow(work, schema), "aligned")
    listed = blocks.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("block").alias("own"), F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = written(listed.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    base = len(_chunks(*(tokenizers or default_tokenizers())).t.b_bytes)
    a_id = F.floor(F.col("pair") / base)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has ids at most
    counts = counts.withColumn("a", a_id).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    back = listed.select("own", "pair").join(counts, "pair")
    names = ["id", *(c for c, _ in DIGEST), *(["groups"] if with_groups else [])]
    result = T.StructType([T.StructField("id", T.LongType()), *(T.StructType.fromDDL(f"{c} {t}")[0] for c, t in DIGEST)])
    if with_groups:
        result = result.add("groups", SPANS)
    to_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow.empty_table()
        n, top = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        if right.num_rows:
            order = np.argsort(right["pair"].to_numpy())
            n, top = right["n"].to_numpy()[order], right["top"].to_numpy()[order]
        out = []
        for texts, data in zip(left["texts"], left["data"], strict=True):
            texts = texts.as_py()
            of, place, times = _unpacked(data.as_py(), len(texts))
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            best_sum = np.concatenate([[0], np.cumsum(np.where(top[place], times, 0))])[ends]
            count_sum = np.concatenate([[0], np.cumsum(n[place] * times)])[ends]
            for i, t in enumerate(texts):
                out.append((t["id"], t["n_a"], t["n_b"], t["n_groups"], t["n_links"], int(best_sum[i + 1] - best_sum[i]), int(count_sum[i + 1] - count_sum[i]), t["sha"], t["groups"]))
        columns = list(zip(*out, strict=True)) or [()] * 9
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, to_arrow)], schema=to_arrow)

    texts = blocks.select("block", "texts", "data")
    return texts.groupBy("block").cogroup(back.groupBy("own")).applyInArrow(summed, result).select(F.col("id").alias("doc_id"), *names[1:])


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_groups=False)
