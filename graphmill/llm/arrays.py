"""NumPy helpers for whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class HashIndex:
    """Position of a 64-bit key in an array of different keys, by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.int64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_key = np.zeros(1 << self.bits, np.int64)
        self.slot_at = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.slot_at[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), bool)
            won[first] = True
            won &= free
            self.slot_key[at[won]], self.slot_at[at[won]] = keys[rest[won]], rest[won]
            rest, at = rest[~won], at[~won] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that are not there."""
        keys = keys.astype(np.int64)
        at = self._slot(keys)
        out = self.slot_at.take(at)
        rest = np.flatnonzero((out >= 0) & (self.slot_key.take(at) != keys))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            here = self.slot_at.take(at[rest])
            out[rest] = here
            rest = rest[(here >= 0) & (self.slot_key.take(at[rest]) != keys[rest])]
        return out


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of at most ``most`` in size together, or of one item."""
    k = 0
    while k < len(sizes):
        end, total = k + 1, sizes[k]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield k, end
        k = end


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (intercept last) of a weighted logistic regression, by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    penalty = ridge * weight.sum() * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
