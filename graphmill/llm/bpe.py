"""Byte-level BPE encoding and decoding with a given rank file.

Each match of the splitting pattern is merged by itself. Over its byte positions stands a segment tree whose
leaves hold the rank of the pair that begins there and whose inner nodes hold the leftmost minimum, so the next
merge is read at the root and each merge updates three leaves (the merged pair, its dead right half and its left
neighbour) in logarithmic time. ``SegmentForest`` runs the trees of many matches of similar length side by side in
NumPy arrays. Results of matches are kept in a bounded table, for words come again and again.

Defined cases: null and empty text give no ids and decode to no bytes; very long matches only make deeper trees;
repeated rows give repeated rows; an empty table gives none; columns other than the id and the text are not looked
at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import text_of

#: Matches kept by an encoder; the table starts anew beyond that. It saves time and changes no result.
KEPT = 600_000
#: Characters encoded at a time.
SLICE = 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of ``base64(token) rank`` lines."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [ranks[k] for k in range(len(ranks))]


class PairRanks:
    """Rank of each pair of tokens that merges: an open-addressing hash table, probed for whole arrays at once."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int32)
        for key, rank in sorted(pairs.items()):
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """The rank of each pair, ``none`` where it does not merge (or one of the two is absent: negative)."""
        key = np.where((a < 0) | (b < 0), np.int64(-2), a.astype(np.int64) << 32 | b)
        at = self._slot(key)
        there = self.keys.take(at)
        out = np.where(there == key, self.ranks.take(at), none)
        rest = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            there = self.keys.take(at[rest])
            hit = there == key[rest]
            out[rest[hit]] = self.ranks.take(at[rest[hit]])
            rest = rest[~hit & (there >= 0)]
        return out


class SegmentForest:
    """Segment trees of leftmost minimum pair ranks, one for each word, advanced together.

    A leaf holds rank * width + position, so that a plain minimum is the leftmost one of least rank. Trees of the
    same width lie in one flat array, ``2 * width`` nodes each.
    """

    def __init__(self, tokens: list[bytes]):
        rank = {t: k for k, t in enumerate(tokens)}
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, k in rank.items():
            for cut in range(1, len(t)):
                if (a := rank.get(t[:cut])) is not None and (b := rank.get(t[cut:])) is not None:
                    pairs[a << 32 | b] = k
        self.pairs = PairRanks(pairs)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.of_bytes = self.pairs.of(self.of_byte[left], self.of_byte[right], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        width = np.int64(1) << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
        for p in np.unique(width).tolist():
            rows, step = np.flatnonzero(width == p), max(1, (1 << 17) // p)
            for k in range(0, len(rows), step):
                part = rows[k : k + step].tolist()
                ids, ends = self._merged([words[r] for r in part], p)
                start = 0
                for r, end in zip(part, ends):
                    out[r] = ids[start:end]
                    start = end
        return out

    def _merged(self, words: list[bytes], p: int) -> tuple[bytes, list[int]]:
        """The ids of all words of this width one after the other, and where those of each word end."""
        n, q = len(words), p + 1
        kind = np.int32 if len(self.pairs.keys) * p < 1 << 31 else np.int64
        none = np.iinfo(kind).max
        raw = np.frombuffer(b"".join(w.ljust(p, b"\0") for w in words), np.uint8).reshape(n, p)
        size = np.array([len(w) for w in words])
        place = np.arange(p)
        # a row of neighbours has one place more, which stands for "none"
        token = np.full((n, q), -1, np.int32)
        token[:, :p] = np.where(place < size[:, None], self.of_byte[raw], -1)
        right = np.full((n, q), p, np.int32)
        right[:, :p] = np.where(place + 1 < size[:, None], place + 1, p)
        left = np.empty((n, q), np.int32)
        left[:] = np.concatenate([[p], place])
        tree = np.full((n, 2 * p), none, kind)
        first = self.of_bytes.take(raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:])
        tree[:, p : 2 * p - 1] = np.where((first < 0) | (place[1:] >= size[:, None]), none, first.astype(kind) * p + place[:-1])
        level = p
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # from here on flat, by row offsets
        token, right, left, tree = token.ravel(), right.ravel(), left.ravel(), tree.ravel()
        todo = np.flatnonzero(tree[1 :: 2 * p] != none)
        while len(todo):
            row, base = todo * q, todo * (2 * p)
            root = tree.take(base + 1)
            merged, at = root // p, root % p
            dead = right.take(row + at)
            after, before = right.take(row + dead), left.take(row + at)
            token[row + dead] = -1
            token[row + at] = merged
            right[row + at] = after
            left[row + after] = at
            leaf = np.concatenate([at, before, dead])
            rank = self.pairs.of(np.concatenate([merged, token.take(row + before)]), np.concatenate([token.take(row + after), merged]), -1)
            value = np.full(len(leaf), none, kind)
            value[: len(rank)] = np.where(rank < 0, none, rank.astype(kind) * p + leaf[: len(rank)])
            real = leaf < p
            offset = np.concatenate([base, base, base])[real]
            node = leaf[real] + p
            tree[offset + node] = value[real]
            for _ in range(p.bit_length() - 1):
                node >>= 1
                child = offset + 2 * node
                tree[offset + node] = np.minimum(tree.take(child), tree.take(child + 1))
            todo = todo[tree.take(base + 1) != none]
        ids = token.reshape(n, q)[:, :p]
        kept = ids >= 0
        return ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()


def latin(pattern: str):
    """``findall`` of the same pattern for texts of code points below 256, by the standard library, which is faster:
    classes are spelled out as the code points that they hold there."""
    spelled = {c: "".join(re.escape(chr(k)) for k in range(256) if regex.match(c, chr(k))) for c in {*regex.findall(r"\\p\{\w+\}", pattern), r"\s"}}
    out, inside = "", False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, flags=regex.DOTALL):
        if part == r"\S" and not inside:
            out += f"[^{spelled[r'\s']}]"
        elif part in spelled:
            out += spelled[part] if inside else f"[{spelled[part]}]"
        elif part.startswith("\\") and part[1].isalpha():
            return regex.compile(pattern).findall  # a class that is not spelled out here
        else:
            inside = part == "[" or inside and part != "]"
            out += part
    return re.compile(out).findall


def _classes(pattern: str) -> list[str]:
    return sorted({*regex.findall(r"\\[pP]\{\^?\w+\}", pattern), *[c.lower() for c in regex.findall(r"\\[sSwWdD]", pattern)]})


@cache
def stand_ins(pattern: str) -> dict[int, int]:
    """Code points that the pattern's classes hold by the Unicode tables of the tiktoken library and not by those of
    ``regex``, or the other way round, each with one that both put where tiktoken puts the former. The library tells its
    classes itself: it drops what a pattern does not match, so encoding all code points by a class leaves the class."""
    import tiktoken

    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    ranks = {bytes([b]): b for b in range(256)}
    theirs = [set(bytes(tiktoken.Encoding("class", pat_str=c, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)).decode()) for c in _classes(pattern)]
    ours = [set(regex.findall(c, every)) for c in _classes(pattern)]
    differ = sorted(set().union(*(a ^ b for a, b in zip(theirs, ours))))
    kind = lambda ch: tuple(ch in a for a in theirs)
    wanted, found = {kind(ch) for ch in differ}, {}
    for ch in every[256:]:
        if wanted <= found.keys():
            break
        if (k := kind(ch)) in wanted and k == tuple(ch in b for b in ours):
            found.setdefault(k, ch)
    return {ord(ch): ord(found[kind(ch)]) for ch in differ if kind(ch) in found}


class Encoder:
    """Encodes texts as the rank file and the pattern say, without special tokens. ``strange``: what ``stand_ins``
    found."""

    def __init__(self, tokens: list[bytes], pattern: str, strange: dict[int, int] | None = None):
        self.tokens, self.whole = tokens, {t: k for k, t in enumerate(tokens)}
        self.pattern, self.find, self.find_latin = regex.compile(pattern), regex.compile(pattern).findall, latin(pattern)
        self.strange = stand_ins(pattern) if strange is None else strange
        self.none_strange = frozenset(map(chr, self.strange)).isdisjoint
        self.forest = SegmentForest(tokens)
        self.known: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.none_strange(text):
                return self.find(text)
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.strange))]
        return self.find_latin(text)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        rest, raw = [], []
        for w in words:
            b = w.encode()
            if (k := self.whole.get(b)) is not None:  # a match that is a token is that token
                self.known[w] = k.to_bytes(4, "little")
            else:
                rest.append(w)
                raw.append(b)
        if rest:
            for w, ids in zip(rest, self.forest.encode(raw)):
                self.known[w] = ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        k = 0
        while k < len(texts):
            end, chars = k + 1, len(texts[k])
            while end < len(texts) and chars + len(texts[end]) <= SLICE:
                chars += len(texts[end])
                end += 1
            found = [self._split(t) for t in texts[k:end]]
            pool = set().union(*found)
            if fresh := pool.difference(self.known):
                if len(self.known) + len(fresh) > KEPT:
                    fresh = pool
                self._learn(fresh)
            get = self.known.__getitem__
            for words in found:
                yield b"".join(map(get, words))
            k = end

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str, strange: dict[int, int] | None = None) -> Encoder:
    """One encoder for a worker process; the rank file is part of the installation on every machine."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern, strange)
    return _ENCODERS[path, pattern]


def _binary(values: Iterable[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each text, packed as little-endian unsigned 32-bit integers."""

    strange = stand_ins(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern, strange)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                yield pa.record_batch([batch.column(0), _binary(use.encode(batch.column(1).to_pylist()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text``: the decoded bytes of each list of ids, as text (bytes that are no UTF-8 are replaced)."""

    strange = stand_ins(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern, strange)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([use.decode(b.as_py()).decode("utf-8", "replace") for b in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``ids`` the ids
    themselves, packed. Works in one pass; without ``ids`` they (four bytes for each token) do not travel."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    strange = stand_ins(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern, strange)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = list(use.encode(batch.column(1).to_pylist()))
                columns = [
                    batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(use.decode(x)).hexdigest() for x in found], pa.string()), *[_binary(found)] * ids,
                ]
                yield pa.record_batch(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)
