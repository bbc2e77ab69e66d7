"""Word shingles of whole texts as sets of 64-bit numbers, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that are hashed at once (a longer text goes by itself).
AT_ONCE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of each word, in order; A-Z count as a-z and words end at white space."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(1 << (len(raw) - 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * up[: len(raw)], dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(bounds, starts, "right"), hashes


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words, the whole sequence as one; without, none."""
    of, hashed = words(texts)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    weights = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashed) - k + 1)
    shingles = np.zeros(n, np.uint64)
    for i in range(k):
        shingles += hashed[i : i + n] * weights[i]
    shingles, out = mixed(shingles), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        else:
            out.append(mixed((hashed[a:b] * weights[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else hashed[:0])
    return out


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, UTF-8 bytes) of runs of texts that are hashed at once; null counts as empty."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        block.append((text or "").encode())
        size += len(block[-1]) + 1
        if size > AT_ONCE:
            yield first, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, block
