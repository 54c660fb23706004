"""The Daubechies wavelet packet transform of windows, as matrices: a window's coefficients are window @ matrix.

Signals go on past their ends as their mirror images (the end value twice). A packet is named
by its path: `a` for the low half of a split, `d` for the high half.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The scaling filter of Daubechies' wavelet with four vanishing moments.
SCALING = (0.2303778133088965, 0.7148465705529157, 0.6308807679298589, -0.027983769416859854, -0.18703481171909309, 0.030841381835560764, 0.0328830116668852, -0.010597401785069032)
_LOW = np.array(SCALING)
_HIGH = _LOW[::-1] * (-1.0) ** np.arange(len(_LOW))


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half of each row: correlation with both filters at every other place."""
    n, size = x.shape[1], len(_LOW)
    wide = np.pad(x, [(0, 0), (size - 2, size)], "symmetric")
    parts = np.lib.stride_tricks.sliding_window_view(wide, size, axis=1)[:, ::2][:, : (n + size - 1) // 2]
    return parts @ _LOW, parts @ _HIGH


def join(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Rows of n values out of their halves."""
    size, k = len(_LOW), low.shape[1]
    out = np.zeros((len(low), 2 * k + size))
    for j in range(size):
        out[:, j : j + 2 * k : 2] += low * _LOW[j] + high * _HIGH[j]
    return out[:, size - 2 : size - 2 + n]


def depth(n: int, level: int) -> int:
    """How often n values can be split, `level` times at most: a filter longer than the signal says nothing."""
    return max(1, min(level, int(np.floor(np.log2(n / (len(_LOW) - 1))))))


@lru_cache(maxsize=32)
def packets(n: int, level: int) -> dict[str, np.ndarray]:
    """Path and matrix of the packets of the last level."""
    found = {"": np.eye(n)}
    for _ in range(level):
        found = {path + half: m for path, x in found.items() for half, m in zip("ad", split(x))}
    return found


def by_frequency(level: int) -> list[str]:
    """Paths from the lowest band to the highest: each high half runs backwards."""
    paths = [""]
    for _ in range(level):
        paths = [x + half for i, x in enumerate(paths) for half in ("ad" if i % 2 == 0 else "da")]
    return paths


@lru_cache(maxsize=32)
def rebuilt(n: int, level: int, paths: frozenset[str]) -> np.ndarray:
    """The matrix that makes a window again out of some of its packets."""
    sizes = [n]
    for _ in range(level):
        sizes.append((sizes[-1] + len(_LOW) - 1) // 2)
    found = {p: x if p in paths else np.zeros_like(x) for p, x in packets(n, level).items()}
    for k in range(level - 1, -1, -1):
        found = {p: join(found[p + "a"], found[p + "d"], sizes[k]) for p in {x[:-1] for x in found}}
    return found[""]


def trend(n: int, level: int) -> np.ndarray:
    level = depth(n, level)
    return rebuilt(n, level, frozenset(["a" * level]))


def smooth(n: int, level: int) -> np.ndarray:
    """Without the highest quarter of the bands."""
    order = by_frequency(depth(n, level))
    return rebuilt(n, depth(n, level), frozenset(order[: -max(1, len(order) // 4)]))


def energies(rows: np.ndarray, level: int) -> dict[str, np.ndarray]:
    """Sum of squares in each packet of each row, after `level` splits."""
    return {p: ((rows @ m) ** 2).sum(1) for p, m in packets(rows.shape[1], level).items()}


def bands(energy: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Energy in packets with few, some and many high halves in their path: thirds of the greatest number."""
    top = max(map(len, energy))
    count = {p: p.count("d") for p in energy}
    zero = np.zeros_like(next(iter(energy.values())))
    pick = lambda least, most: sum((e for p, e in energy.items() if least < count[p] <= most), zero)
    return pick(-1, top // 3), pick(top // 3, 2 * top // 3), pick(2 * top // 3, top)
