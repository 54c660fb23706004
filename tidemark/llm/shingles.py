"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at space and \\x09-\\x0D; nothing else changes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; fewer words are one run; no words, none."""
    h = word_hashes(text)
    n = min(size, len(h))
    if not n:
        return h
    with np.errstate(over="ignore"):
        run = h[: len(h) - n + 1] + np.uint64(n)
        for k in range(1, n):
            run = mixed(run) * _ODD + h[k : len(h) - n + 1 + k]
        return np.unique(mixed(run))


def set_digest(hashes: np.ndarray) -> bytes:
    return xxh3_128_digest(hashes.tobytes())
