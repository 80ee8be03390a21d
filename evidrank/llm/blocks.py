"""Names of equal blocks: equal numbers for equal stretches of a sequence, found by sorting pairs of shorter names.

Nothing is hashed, so equal names always mean equal stretches.
"""

from __future__ import annotations

import numpy as np


def numbered(keys: np.ndarray) -> np.ndarray:
    """Dense numbers in the order of the keys."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return numbered(left * (int(right.max(initial=0)) + 1) + right)


def doubled(symbols: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
    """names[k][i] names symbols[i : i + 2**k], for every power of two up to ``longest`` (or the whole)."""
    n = len(symbols)
    most = n if longest is None else min(n, longest)
    names = [numbered(symbols)] if n else []
    while names and 2 << (len(names) - 1) <= most:
        half = 1 << (len(names) - 1)
        names.append(joined(names[-1][:-half], names[-1][half:]))
    return names


def windows(symbols: np.ndarray, width: int) -> np.ndarray:
    """Names of all stretches of ``width`` symbols, each of two blocks that overlap or touch."""
    if len(symbols) < width:
        return np.zeros(0, np.int64)
    names = doubled(symbols, width)
    size = 1 << (len(names) - 1)
    n = len(symbols) - width + 1
    return names[-1][:n] if size == width else joined(names[-1][:n], names[-1][width - size : width - size + n])


def common_after(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a on agree with those from b on, for arrays of places a < b."""
    n, same = len(names[0]), np.zeros(len(a), np.int64)
    for k in reversed(range(len(names))):
        fits = b + same + (1 << k) <= n
        x, y = np.where(fits, a + same, 0), np.where(fits, b + same, 0)
        same += np.where(fits & (names[k][x] == names[k][y]), 1 << k, 0)
    return same


def common_before(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before a agree with those before b, for arrays of places a < b."""
    same = np.zeros(len(a), np.int64)
    for k in reversed(range(len(names))):
        fits = a - same - (1 << k) >= 0
        x, y = np.where(fits, a - same - (1 << k), 0), np.where(fits, b - same - (1 << k), 0)
        same += np.where(fits & (names[k][x] == names[k][y]), 1 << k, 0)
    return same
