"""Arrays of whole numbers packed into one binary value, so that millions of them travel through Spark in a few rows."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(**arrays: np.ndarray) -> bytes:
    """The arrays of non-negative whole numbers: byte by byte of all numbers, lowest first, as far as the largest has any, deflated."""
    head, planes = {}, []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x).astype("<u8", copy=False)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head[name] = [len(x), width]
        planes += [np.ascontiguousarray(x.view(np.uint8)[i::8]) for i in range(width)]
    raw = b"".join([json.dumps(head).encode(), b"\n", *planes])
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of pack(), as unsigned 64-bit numbers."""
    raw = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    at, out = raw.index(b"\n") + 1, {}
    for name, (n, width) in json.loads(raw[: at - 1]).items():
        out[name] = np.zeros(n, "<u8")
        for i in range(width):
            out[name].view(np.uint8)[i::8] = np.frombuffer(raw, np.uint8, n, at)
            at += n
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, which take fewer bytes; from_gaps() sums them up again."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def from_gaps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)
