"""Hashed features of whole texts, computed for many texts at once with numpy.

A text becomes bytes; the hash of any byte range is the difference of two running
polynomial sums, scaled by a power of the odd base's inverse (all modulo 2^64).
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * MIX


class Ranges:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=self.sums[1:])
        self.back = _power(INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + np.array([salt], dtype=np.uint64) * MIX)


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space around each text, and the start of each text."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return buf, np.concatenate([[1], 1 + np.cumsum(sizes)])[: len(texts)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last element are False."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edge[::2], edge[1::2]


def grouped(doc: np.ndarray, feature: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features per text: (offsets of the texts, features, counts)."""
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(32)) | feature.astype(np.uint64), return_counts=True)
    owner = (key >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(owner, np.arange(n_docs + 1)), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count
