"""Byte-level BPE: encoding by a lazily determinised transducer, decoding through an incremental UTF-8 machine.

Merges are compiled on demand. Two adjacent tokens are stable if merging their joined bytes by rank gives the two back;
a token sequence is the BPE encoding of its bytes exactly if all its neighbours are stable, so every prefix of a text
has one last token. A place is open as long as the bytes since then are still a beginning of some token. A state of the
transducer is (bytes since the first open place, the last token at each open place): all that later tokens depend on.
Reading a byte gives the last token of the longer prefix. Tokens that the ways to all open places have in common are
emitted, so the lookahead stays within a few of the longest tokens. States and arcs are made when first met and kept,
which determinises the machine for the texts at hand.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arcs, and words of each of two generations, that a worker keeps before it starts afresh.
KEPT_ARCS, KEPT_WORDS = 400_000, 300_000
#: Texts that are taken out of an Arrow batch together.
AT_ONCE = 256
#: Bytes of a piece that are read before what is certain is emitted.
LOOK = 1024

#: Letters of Latin-1 without its three signs that count as letters.
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


class Transducer:
    """Merge ranks, compiled into a byte-to-token transducer as texts need it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.sizes = [len(t) for t in self.token_bytes]
        self.beginnings = {token[:i] for token in ranks for i in range(len(token))}
        self.longest = max(map(len, ranks))
        self.stable: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self._forget()

    def _forget(self) -> None:
        """Back to the state before any byte: one open place, with no token before it.

        A state is one run of bytes, its number of places, its places and their tokens as 32-bit numbers and then what was
        read, and an arc one number (token << 40 | next state << 8): a worker holds hundreds of thousands of either.
        """
        self.states = [array("i", (1, 0, -1)).tobytes()]
        self.number = {self.states[0]: 0}
        self.arcs = _Arcs(self)

    def merged(self, raw: bytes, least: int = 1) -> list[bytes]:
        """The definition: of all adjacent parts, the pair whose union has the lowest rank is joined, until none is left.

        Stops at `least` parts.
        """
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > least:
            found = min(((r, i) for i in range(len(parts) - 1)
                         if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if found is None:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return parts

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts of a token at its right or left end, each with the rank of the merge that takes it up."""
        edges = self.edges[right]
        if token not in edges:
            raw, until, out = self.token_bytes[token], float("inf"), []
            while True:
                out.append((raw, until))
                if len(raw) == 1:
                    break
                until, raw = self.ranks[raw], self.merged(raw, 2)[1 if right else 0]
            edges[token] = out
        return edges[token]

    def _is_stable(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border: at no rank do two parts that stand there then have a union of that rank.

        On equal ranks the leftmost pair is joined first. merged(left + right) == [left, right] says the same, slower.
        """
        stable, rank_of = True, self.ranks.get
        for a, a_until in self.edges[True].get(left) or self._edge(left, True):
            for b, b_until in self.edges[False].get(right) or self._edge(right, False):
                r = rank_of(a + b)
                if r is not None and r < a_until and r <= b_until:
                    stable = False
        if len(self.stable) > 2 * KEPT_ARCS:
            self.stable.clear()
        self.stable[left << 32 | right] = stable
        return stable

    def _state(self, state: int) -> tuple[bytes, array, array]:
        """(bytes since the first open place, the open places, the last token at each)."""
        packed = self.states[state >> 8]
        numbers = array("i", packed[: 4 + 8 * int.from_bytes(packed[:4], sys.byteorder)])
        return packed[4 * len(numbers) :], numbers[1 : 1 + numbers[0]], numbers[1 + numbers[0] :]

    def arc(self, state: int, byte: int) -> int:
        """The last token of the prefix that ends with byte, and the next state, each shifted to leave room for what follows."""
        read, places, lasts = self._state(state)
        read += bytes((byte,))
        rank_of, stable, beginnings, token = self.ranks.get, self.stable, self.beginnings, None
        still, left_at = [], []
        for start, left in zip(places, lasts, strict=True):
            rest = read[start:]
            if token is None and (found := rank_of(rest)) is not None:
                fits = left < 0 or stable.get(left << 32 | found)
                if self._is_stable(left, found) if fits is None else fits:
                    token = found
            if rest in beginnings:
                still.append(start)
                left_at.append(left)
        if token is None:
            raise ValueError(f"no token ends {read!r}")
        still.append(len(read))
        left_at.append(token)
        first = still[0]
        key = array("i", [len(still), *[i - first for i in still], *left_at]).tobytes() + read[first:]
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return token << 40 | to << 8

    def _way(self, lasts: list[int], end: int) -> list[int]:
        """The ends of the tokens on the way to a place, last first."""
        ends, sizes = [], self.sizes
        while end > 0:
            ends.append(end)
            end -= sizes[lasts[end - 1]]
        return ends

    def encode(self, raw: bytes) -> list[int]:
        """The tokens of one piece of text."""
        if len(self.arcs) > KEPT_ARCS:
            self._forget()
        state, out, lasts, arcs = 0, [], [], self.arcs
        for cut in range(0, len(raw), LOOK):
            for byte in raw[cut : cut + LOOK]:
                arc = arcs[state | byte]
                state = arc & 0xFFFFFFFFFF
                lasts.append(arc >> 40)
            if cut + LOOK < len(raw):
                # what all ways have in common is certain; every way on starts at an open place
                read, places, _ = self._state(state)
                ways = [set(self._way(lasts, len(lasts) - len(read) + place)) for place in places]
                if certain := max(set.intersection(*ways), default=0):
                    out += [lasts[end - 1] for end in self._way(lasts, certain)[::-1]]
                    del lasts[:certain]
        return out + [lasts[end - 1] for end in self._way(lasts, len(lasts))[::-1]]


class _Arcs(dict):
    """Arcs by (state | byte), made when first taken."""

    def __init__(self, of: Transducer):
        self.of = of

    def __missing__(self, key: int) -> int:
        arc = self[key] = self.of.arc(key & ~0xFF, key & 0xFF)
        return arc


class Utf8Machine:
    """An incremental UTF-8 decoder over tokens: characters come out once their last byte is in.

    The state between bytes is (continuation bytes that are due, lowest, highest next byte); None is an error. Between
    tokens it is told by the bytes held. Tokens that lead from the ground state back to it are known from the start, and
    runs of them are decoded together; what any other token does is found byte by byte once and kept in `moves`.
    """

    GROUND = 0, 0, 0

    def __init__(self, token_bytes: list[bytes], whole: np.ndarray, moves: dict[tuple[bytes, bytes], tuple[bytes, str]] | None = None) -> None:
        self.token_bytes, self.whole, self.moves = token_bytes, whole, {} if moves is None else moves
        self.held = b""

    @staticmethod
    def step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        due, low, high = state
        if due:
            return (due - 1, *((0x80, 0xBF) if due > 1 else (0, 0))) if low <= byte <= high else None
        if byte < 0x80:
            return Utf8Machine.GROUND
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    @classmethod
    def is_whole(cls, raw: bytes) -> bool:
        """Whether raw leads from the ground state back to it without an error."""
        state: tuple[int, int, int] | None = cls.GROUND
        for byte in raw:
            state = cls.step(state, byte)
            if state is None:
                return False
        return state == cls.GROUND

    def _moved(self, held: bytes, raw: bytes) -> tuple[bytes, str]:
        """The bytes held after raw, and the characters that it completes or breaks."""
        out, state = [], self.GROUND
        for byte in held:
            state = self.step(state, byte)
        for byte in raw:
            after = self.step(state, byte)
            if after is None and held:  # the character begun is broken; the byte may begin another
                out.append("\ufffd")
                held, after = b"", self.step(self.GROUND, byte)
            if after is None:
                out.append("\ufffd")
                state = self.GROUND
                continue
            state, held = after, held + bytes((byte,))
            if after == self.GROUND:
                out.append(held.decode())
                held = b""
        return held, "".join(out)

    def _move(self, token: bytes) -> str:
        key = self.held, token
        move = self.moves.get(key)
        if move is None:
            move = self.moves[key] = self._moved(*key)
        self.held = move[0]
        return move[1]

    def feed(self, ids: np.ndarray) -> str:
        """The characters that are complete; bytes that are no UTF-8 become U+FFFD."""
        tokens, out, at = list(map(self.token_bytes.__getitem__, ids.tolist())), [], 0
        for broken in [*np.flatnonzero(~self.whole[ids]).tolist(), len(tokens)]:
            while at < broken and self.held:
                out.append(self._move(tokens[at]))
                at += 1
            out.append(b"".join(tokens[at:broken]).decode())
            if broken < len(tokens):
                out.append(self._move(tokens[broken]))
            at = broken + 1
        return "".join(out)

    def close(self) -> str:
        held, self.held = self.held, b""
        return "\ufffd" if held else ""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the bytes of a rank file: one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, raw.splitlines()))}


class Codec:
    """Encodes and decodes whole texts; each match of the pattern is encoded by itself."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.fst = fst = Transducer(read_ranks(raw))
        self.any_text = regex.compile(pattern).findall
        # For texts of these characters alone, white space, letters and digits are short lists, which `re` finds faster.
        self.unlisted = re.compile(f"[^\t\n\r -~{LETTERS}]").search
        plain = re.sub(r"(?<!\[\^\\s)\\p\{([LN])\}(?!\\p|\])", r"[\\p{\1}]", pattern)
        self.listed_text = re.compile(plain.replace(r"\p{L}", "A-Za-z" + LETTERS).replace(r"\p{N}", "0-9")).findall
        self.token_bytes = fst.token_bytes
        self.whole = np.array([Utf8Machine.is_whole(t) for t in fst.token_bytes])
        self.moves: dict[tuple[bytes, bytes], tuple[bytes, str]] = {}
        self.decimal = [str(i) for i in range(len(fst.token_bytes))]

        class Words(dict):
            """Words with their tokens as 32-bit numbers; those not met for a generation are forgotten."""

            old: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                ids = self.old.get(word)
                if ids is None:
                    raw = word.encode()
                    whole = fst.ranks.get(raw)
                    ids = np.array(fst.encode(raw) if whole is None else [whole], np.int32).tobytes()
                if len(self) >= KEPT_WORDS:
                    self.old = dict(self)
                    self.clear()
                if len(word) <= 64:
                    self[word] = ids
                return ids

        self.words = Words()

    def encode(self, text: str | None) -> np.ndarray:
        """The tokens of a whole text; none for null."""
        text = text or ""
        split = self.any_text if self.unlisted(text) else self.listed_text
        return np.frombuffer(b"".join(map(self.words.__getitem__, split(text))), np.int32)

    def decode(self, ids: np.ndarray, at_once: int = 65536) -> Iterator[str]:
        """The text in pieces, at_once tokens each; a character whose bytes lie in two pieces comes with the later one."""
        machine = Utf8Machine(self.token_bytes, self.whole, self.moves)
        for i in range(0, len(ids), at_once):
            yield machine.feed(ids[i : i + at_once])
        if last := machine.close():
            yield last


@lru_cache(2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def _release() -> None:
    """Drops the codecs of this process and gives their memory back to the machine."""
    _codec.cache_clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def default_vocabulary() -> tuple[bytes, str]:
    """The bytes of the 50k rank file and the pattern that splits texts."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def _encoded(batches: Iterable[pa.RecordBatch], vocabulary: tuple[bytes, str], n_keep: int, names: list[str], with_ids: bool, lasting: bool) -> Iterator[pa.RecordBatch]:
    """The first n_keep columns of the batches with the results for the text in the column after them."""
    try:
        codec = _codec(*vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                tokens, counts, ids_sha, decoded_sha = [], [], [], []
                for text in part.column(n_keep).to_pylist():
                    ids, digest = codec.encode(text), hashlib.sha256()
                    for piece in codec.decode(ids):
                        digest.update(piece.encode())
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    decoded_sha.append(digest.hexdigest())
                    if with_ids:
                        tokens.append(ids)
                columns = [*part.columns[:n_keep], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)
    finally:
        codec = None
        if not lasting:
            _release()


def encoded(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: tuple[bytes, str] | None = None,
            with_ids: bool = True, lasting: bool = True) -> DataFrame:
    """The columns `keep` of docs with n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids), and ids
    if asked for.

    Every row is by itself: no shuffle, and a worker's memory is bounded by the vocabulary (a file of fixed size,
    broadcast), the kept arcs and words, and AT_ONCE texts with their tokens. Workers outlive tasks, and there may be
    more of them than tasks at a time: lasting=False has a worker give up arcs and words after each task, so that those
    that wait hold none; what is kept saves learning them anew. Defined cases: a null text counts as empty
    (no tokens); equal rows give equal rows, as often as they come; no rows give no rows; of `keep` the columns that
    docs lacks are left out, and so are those named like a result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or default_vocabulary())
    results = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        results = results.add("ids", T.ArrayType(T.IntegerType()))
    taken = {c.lower() for c in results.names}
    keep = [c for c in keep if c in docs.columns and c.lower() not in taken]
    schema = T.StructType([*docs.select(keep).schema.fields, *results.fields])
    n_keep, names = len(keep), schema.names

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, shared.value, n_keep, names, with_ids, lasting)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(encode, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], with_ids=False)
