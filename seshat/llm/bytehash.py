"""Vectorised hashing of byte runs: every 2^k-byte window of a buffer at once, in NumPy.

`levels` doubles: the hash of 2k bytes mixes the hashes of its two halves, so all windows of
1, 2, 4 ... 64 bytes cost a handful of passes over the buffer, and longer runs are keyed by
two or three overlapping windows. Hashes depend on content alone, never on position.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes x in place when it can."""
    x = x ^ (x >> U(32))
    x *= C3
    x ^= x >> U(29)
    return x


def byte_table() -> np.ndarray:
    return mix(mix((np.arange(256, dtype=np.uint64) + U(1)) * C1))


TABLE = byte_table()


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two hashes."""
    x = a * C1
    x ^= (b + C3) * C2
    x ^= x >> U(31)
    return x


def levels(buf: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size (powers of two), hashes of all windows of that many bytes."""
    h, k, out = TABLE[buf], 1, {}
    while k < max(sizes) and len(h) > k:
        h = join(h[:-k], h[k:])
        k *= 2
        if k in sizes:
            out[k] = h
    return [out.get(s, np.zeros(0, np.uint64)) for s in sizes]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    k = 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (w - k)], v[w - k :]) if w > k else v
