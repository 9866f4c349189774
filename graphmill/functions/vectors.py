"""Degree vectors of multisets of edges, for many graphs of n vertices at once.

A vector is packed in a long, five bits for each vertex. Those that d edges can have on n vertices are the rows of a
table; a graph is a bit of a row's words, set if d of its own edges have that vector. Adding an edge moves rows, so 64
graphs grow with one operation on a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS = 5
#: Graphs that are counted together, rows that are moved together, and bounds of where that pays: graphs, and cells of the tables of moves.
BLOCK, ROWS, FEWEST, MOST_MOVES = 256, 8192, 8, 50_000_000


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for j in range(n) for i in range(j)]


@lru_cache(maxsize=64)
def _table(n: int, d: int) -> np.ndarray:
    """All vectors of n numbers from 0 to d whose sum is 2 d, in order."""
    code, total = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for v in range(n - 1):
        value = np.arange(d + 1)
        code, total = (code[:, None] + (value << BITS * v)).ravel(), (total[:, None] + value).ravel()
        fits = (total <= 2 * d) & (total + d * (n - 1 - v) >= 2 * d)
        code, total = code[fits], total[fits]
    return np.sort(code + (2 * d - total << BITS * (n - 1)))


@lru_cache(maxsize=64)
def _moves(n: int, d: int) -> np.ndarray:
    """(pairs, rows) rows of the next table after an edge is added."""
    here, there = _table(n, d), _table(n, d + 1)
    return np.stack([np.searchsorted(there, here + (1 << BITS * i) + (1 << BITS * j)).astype(np.int32) for i, j in _pairs(n)])


@lru_cache(maxsize=256)
def _rows(n: int, d: int) -> int:
    """Rows of ``_table(n, d)``, counted without it."""
    ways = [1] + [0] * (2 * d)
    for _ in range(n):
        ways = [sum(ways[s - v] for v in range(min(d, s) + 1)) for s in range(2 * d + 1)]
    return ways[2 * d]


def _column_sums(x: np.ndarray) -> np.ndarray:
    """How many rows have each bit of the words, by full adders over thirds of the rows."""
    if len(x) < 96:
        return np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    k = len(x) // 3
    a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
    odd = a ^ b
    return _column_sums(np.concatenate([odd ^ c, x[3 * k :]])) + 2 * _column_sums(a & b | odd & c)


def _together(n: int, last: int, steps: list[list[int]]) -> np.ndarray:
    place = {(1 << BITS * i) + (1 << BITS * j): k for k, (i, j) in enumerate(_pairs(n))}
    words = -(-len(steps) // 64)
    has = np.zeros((len(place), words * 64), bool)
    for g, own in enumerate(steps):
        has[[place[s] for s in own], g] = True
    masks = np.packbits(has, axis=1, bitorder="little").view(np.uint64)
    used = np.flatnonzero(masks.any(axis=1))
    front, out = np.full((1, words), ~np.uint64(0)), np.ones((len(steps), last + 1), np.int64)
    old, new = np.empty((2, ROWS, words), np.uint64)
    for d in range(last):
        moves, grown = _moves(n, d), np.zeros((len(_table(n, d + 1)), words), np.uint64)
        for at in range(0, len(front), ROWS):
            part = front[at : at + ROWS]
            x, y = old[: len(part)], new[: len(part)]
            for e in used:
                to = moves[e, at : at + ROWS]
                np.take(grown, to, axis=0, out=x, mode="clip")
                np.bitwise_and(part, masks[e], out=y)
                np.bitwise_or(x, y, out=x)
                grown[to] = x
        front = grown
        out[:, d + 1] = _column_sums(front)[: len(steps)]
    return out


def _alone(last: int, steps: list[int]) -> list[int]:
    own, front, sizes = np.array(sorted(set(steps)), np.int64), np.zeros(1, np.int64), [1]
    for _ in range(last):
        found = np.empty(0, np.int64)
        for k in range(0, len(own), 8):
            found = np.unique(np.concatenate([found, (front[:, None] + own[k : k + 8]).ravel()]))
        front = found
        sizes.append(len(front))
    return sizes


def sizes(n: int, last: int, steps: list[list[int]]) -> list[list[int]]:
    """How many different vectors 0 to ``last`` edges have, for each graph's packed edges (``steps``)."""
    cells = sum(_rows(n, d) for d in range(last)) * (n * (n - 1) // 2)
    if n < 2 or len(steps) < FEWEST or cells > MOST_MOVES:
        return [_alone(last, own) for own in steps]
    return [row for k in range(0, len(steps), BLOCK) for row in _together(n, last, steps[k : k + BLOCK]).tolist()]
