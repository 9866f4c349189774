"""Words of whole batches of texts as 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(texts: list[bytes], separates: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts one after the other, A-Z lower-cased, and the number of words of each text. Words are
    runs of bytes that are not in ``separates`` (a table of 256, with the newline; by default ``[^\\x20\\x09-\\x0D]+``). A
    word's hash is a difference of prefix sums, so all come out of a few array operations."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    up, down = _powers(1 << max(16, (len(raw) - 1).bit_length()))
    word = ~separates[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[_LOWER[raw]] * up[: len(raw)])])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    last = np.cumsum(size)
    return hashes, np.diff(np.searchsorted(start, np.concatenate([[0], last])))
