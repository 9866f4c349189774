"""Benchmark decontamination by suffix arrays of the training documents.

Documents go in shards of bounded size. A shard's words become numbers (their rank among the words of the tests; 0 for a
word that no test has), and its suffix array lists the suffixes that begin with a known word, sorted as far as the
longest test reaches; an unknown word and the end of a document end a suffix. Every suffix of every test is found in every
shard by binary search: its neighbours give its longest verbatim match there, with the place, and if that is at least a
window long, all places of the window are a range of the array. A window is ``window`` consecutive words of an item, or
all words of a shorter item; a word of a document within any place of a window is hit, and documents with a hit are
affected.

Nothing is shuffled: a shard is what a task holds of its documents. The tests are dealt in blocks of at most ``BLOCK`` words
and each is broadcast, so the size of a broadcast is bounded; items are cut in pieces that overlap by a window less one
word, so any window lies in one piece (a match is followed as far as its piece goes). Further blocks make further passes
over the documents, whose findings are joined by the digest of the text. Words are compared by 64-bit hashes: for a million
different test words and 10^9 different words of documents a false match of a single word has probability below 10^-4, and
a hit takes a whole window of them.

Defined cases: null texts have no words; very long texts and items are taken whole; items without words find nothing; items
that share an id count once; an item without an id hits but is not listed; repeated rows and equal texts have equal
findings; empty tables give no rows or no hits; columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.arrays import HashIndex, slices
from graphmill.llm.common import text_of, written
from graphmill.llm.words import word_hashes

WINDOW = 10
#: Bytes of documents in a shard (or one document), words of a piece of an item, words of a broadcast block of tests.
SHARD, PIECE, BLOCK = 8_000_000, 4096, 2_000_000

#: Bytes that separate words: all of ASCII but digits and letters.
SEPARATES = np.ones(256, bool)
SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``words`` (numbers, 0 ends a suffix; the last is 0) of the suffixes that begin with another number than 0,
    sorted by their first ``depth`` numbers at least. Prefix doubling; a round sorts only what is not told apart yet."""
    ends = np.flatnonzero(words == 0)
    at = np.flatnonzero(words)
    run = np.zeros(len(words), np.int64)
    run[at] = ends[np.searchsorted(ends, at)] - at
    order = at[np.argsort(words[at], kind="stable")]
    rank = np.zeros(len(words), np.int64)
    key, open_ = words[order].astype(np.int64), np.arange(len(order))
    width = 1
    while len(open_):
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))] + 1
        if width >= depth:
            break
        group = np.cumsum(fresh) - 1
        going = np.bincount(group, run[order[open_]] > width) > 0
        open_ = open_[(np.bincount(group) > 1)[group] & going[group]]
        if not len(open_):
            break
        place = order[open_]
        ahead = np.where(run[place] > width, rank[np.minimum(place + width, len(rank) - 1)], 0)
        key = rank[place] << 32 | ahead
        sort = np.argsort(key, kind="stable")
        order[open_], key = place[sort], key[sort]
        width *= 2
    return order


def common(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of suffixes of ``a`` and of ``b``, ``most`` at most."""
    n, live = np.zeros(len(at_a), np.int64), np.arange(len(at_a))
    while len(live):
        if most is not None:
            live = live[n[live] < most[live]]
        x = a[at_a[live] + n[live]]
        live = live[(x == b[at_b[live] + n[live]]) & (x > 0)]
        n[live] += 1
    return n


def bound(words: np.ndarray, order: np.ndarray, tests: np.ndarray, at: np.ndarray, most: np.ndarray | None = None, after: bool = False) -> np.ndarray:
    """For each test suffix (cut to ``most``) the first of the sorted suffixes that isn't before it, or that is after all
    that begin with it."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        place, t = order[middle], at[live]
        n = common(words, place, tests, t, None if most is None else most[live])
        whole = np.zeros(len(live), bool) if most is None else n == most[live]
        before = np.where(whole, after, words[place + n] < tests[t + n])
        low[live[before]] = middle[before] + 1
        high[live[~before]] = middle[~before]
    return low


class Tests:
    """A block of pieces of test items: their words as numbers, one after the other with a 0 behind each."""

    def __init__(self, items: list[str | None], pieces: list[np.ndarray], windows: list[int]):
        self.items = np.array(sorted({i for i in items if i is not None}), object)
        number = {name: k for k, name in enumerate(self.items)}
        known = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.uint64)
        self.index = HashIndex(known.view(np.int64))
        self.longest = max(map(len, pieces), default=0)
        place, words, at, item, window, size = 0, [], [], [], [], []
        for name, own, wide in zip(items, pieces, windows):
            words += [self.index.find(own.view(np.int64)).astype(np.int64) + 1, np.zeros(1, np.int64)]
            at.append(np.arange(place, place + len(own)))
            item.append(np.full(len(own), number.get(name, -1)))
            size.append(np.arange(len(own), 0, -1))
            window.append(np.full(len(own), wide))
            place += len(own) + 1
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.words, self.at, self.item, self.window, self.size = map(joined, (words, at, item, window, size))
        self.base = np.cumsum([0, *(len(p) + 1 for p in pieces)])

    def search(self, hashes: np.ndarray, counts: np.ndarray):
        """Of a shard (word hashes of its documents, and how many each has): which words are hit, which (document, item)
        pairs there are, and the longest match of each test suffix of a window or more, as (suffix, place, length)."""
        first = np.cumsum(counts + 1) - (counts + 1)  # a 0 ends each document
        words = np.zeros(int(counts.sum()) + len(counts) + 1, np.int64)
        real = np.ones(len(words) - 1, bool)
        real[first + counts] = False
        words[:-1][real] = self.index.find(hashes.view(np.int64)) + 1
        order = suffix_array(words, self.longest)
        none = np.zeros(0, np.int64)
        if not len(order) or not len(self.at):
            return np.zeros(len(hashes), bool), first, real, (none, none), (none, none, none)
        found = bound(words, order, self.words, self.at)
        before, here = order[np.maximum(found - 1, 0)], order[np.minimum(found, len(order) - 1)]
        far, near = common(words, before, self.words, self.at), common(words, here, self.words, self.at)
        length, place = np.maximum(far, near), np.where(far > near, before, here)
        hit = np.flatnonzero((self.size >= self.window) & (length >= self.window))
        at, wide = self.at[hit], self.window[hit]
        low, high = bound(words, order, self.words, at, wide), bound(words, order, self.words, at, wide, after=True)
        window, which = np.unique(np.stack([low, high, wide], axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        step, pairs = np.zeros(len(words) + 1, np.int64), []
        of = np.unique(np.stack([which, self.item[hit]], axis=1), axis=0)
        bounds = np.searchsorted(of[:, 0], np.arange(len(window) + 1))
        for k, (a, b, w) in enumerate(window.tolist()):
            places = order[a:b]
            step[places] += 1  # the places of a window are different
            step[places + w] -= 1
            doc, items = np.unique(np.searchsorted(first, places, "right") - 1), of[bounds[k] : bounds[k + 1], 1]
            pairs.append(np.stack([np.repeat(doc, len(items)), np.tile(items, len(doc))], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 1] >= 0]
        covered = np.cumsum(step[: len(real)])[real] > 0
        # a match that the suffix before it has too, longer by one, is not listed
        follows = np.zeros(len(hit), bool)
        follows[1:] = (self.at[hit][1:] == self.at[hit][:-1] + 1) & (place[hit][1:] == place[hit][:-1] + 1)
        top = hit[~follows]
        return covered, first, real, (pairs[:, 0], pairs[:, 1]), (top, place[top], length[top])


def pieces(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``item_id, at, window, words``: the hashes of the words of the pieces of all items, and where each piece begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = word_hashes([text.as_py()], SEPARATES)[0]
                starts = range(0, max(1, len(h) - window + 1), piece - window + 1)
                own = [(k, h[k : k + piece].tobytes()) for k in starts if len(h)]
                yield pa.record_batch([pa.array([name] * len(own), pa.string()), pa.array([k for k, _ in own], pa.int64()), pa.array([min(window, len(h))] * len(own), pa.int32()), pa.array([b for _, b in own], pa.binary())], ["item_id", "at", "window", "words"])

    return items.select(F.col(id_col).cast("string").alias("item_id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "item_id string, at long, window int, words binary")


def _blocks(rows: DataFrame, block: int) -> Iterator[tuple[Tests, np.ndarray]]:
    """Blocks of tests of at most ``block`` words (and a piece), one at a time, with where their pieces begin."""
    held: list = []
    size = 0
    for r in rows.toLocalIterator():
        held.append(r)
        size += len(r["words"]) // 8
        if size >= block:
            yield _tests(held), np.array([x["at"] for x in held])
            held, size = [], 0
    yield _tests(held), np.array([x["at"] for x in held], np.int64)


def _tests(rows: list) -> Tests:
    return Tests([r["item_id"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows], [r["window"] for r in rows])


_FOUND = "doc_id long, text_sha256 binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>, matches array<struct<item_id:string,item_at:long,doc_at:long,words:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())]))


def _search(docs: DataFrame, tests: Tests, begins: np.ndarray, shard: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((tests, begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, begins = shared.value
        for whole in batches:
            for a, b in slices([len(t.as_py()) for t in whole.column(1)], shard):
                batch = whole.slice(a, b - a)
                texts = batch.column(1).to_pylist()
                hashes, counts = word_hashes(texts, SEPARATES)
                covered, first, _, (doc, item), (suffix, place, length) = tests.search(hashes, counts)
                spans, items, matches = ([[] for _ in texts] for _ in range(3))
                start = np.cumsum(counts) - counts  # without the ends between documents
                edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    while x < y:  # a run of hit words may go on from one document to the next
                        d = int(np.searchsorted(start, x, "right")) - 1
                        end = min(y, int(start[d] + counts[d]))
                        spans[d].append({"start": x - int(start[d]), "end": end - int(start[d])})
                        x = end
                for d, i in zip(doc.tolist(), item.tolist()):
                    items[d].append(tests.items[i])
                owner = np.searchsorted(first, place, "right") - 1
                piece = np.searchsorted(tests.base, tests.at[suffix], "right") - 1
                for s, d, p, n, q in zip(suffix.tolist(), owner.tolist(), place.tolist(), length.tolist(), piece.tolist()):
                    name = tests.items[tests.item[s]] if tests.item[s] >= 0 else None
                    matches[d].append({"item_id": name, "item_at": int(tests.at[s] - tests.base[q] + begins[q]), "doc_at": p - int(first[d]), "words": n})
                digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.record_batch([batch.column(0), digest, pa.array(counts), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCHES)], ["doc_id", "text_sha256", "n_words", "spans", "items", "matches"])

    return docs.mapInArrow(run, _FOUND)


def _merged(spans: Column) -> Column:
    """Spans in order that neither meet nor overlap."""
    last = lambda done: F.element_at(done, -1)
    wider = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    step = lambda done, s: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), wider(done, s)).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """A row for each document: ``doc_id, text_sha256`` (32 bytes)``, n_words, spans`` (ranges of hit words, in order), ``items``
    (sorted ids whose windows occur) and ``matches`` (the longest verbatim match of each test suffix within a shard that is
    in this document: item, its word, the document's word, number of words)."""
    tests = written(pieces(items, item_col, item_text, window, piece), "decontaminate-tests")
    own = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    found, more = None, []
    for block_tests, begins in _blocks(tests, block):
        part = _search(own, block_tests, begins, shard)
        if found is None:
            found = part
        else:
            part = part.filter(F.size("spans") > 0).groupBy("text_sha256").agg(*[F.any_value(c).alias(c) for c in ("spans", "items", "matches")])
            more.append(written(part, "decontaminate-hits"))
    if not more:
        return found
    rest = more[0]
    for part in more[1:]:
        rest = rest.unionByName(part)
    rest = rest.groupBy("text_sha256").agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("spans", "items", "matches")])
    joined = found.join(rest, "text_sha256", "left")
    both = lambda c: F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"more_{c}"))
    return joined.select("doc_id", "text_sha256", "n_words", _merged(both("spans")).alias("spans"), F.array_sort(F.array_distinct(both("items"))).alias("items"), both("matches").alias("matches"))


def longest(found: DataFrame) -> DataFrame:
    """``item_id, item_at, words, doc_id, doc_at``: the longest verbatim match of each listed test suffix over all shards."""
    m = found.select("doc_id", F.explode("matches").alias("m"))
    best = m.groupBy("m.item_id", "m.item_at").agg(F.max(F.struct("m.words", F.negate("doc_id").alias("least"), "doc_id", "m.doc_at")).alias("b"))
    return best.select("item_id", "item_at", "b.words", "b.doc_id", "b.doc_at")


def remove(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not affected, whole. ``found``: of ``contamination``."""
    bad = found.filter(F.size("spans") > 0).select(F.col("text_sha256").alias("_affected")).distinct()
    digest = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    return docs.join(bad, digest == bad["_affected"], "left_anti")


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS pos FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS gram FROM s),
p AS (SELECT doc, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d JOIN (SELECT DISTINCT size FROM win) ON len(w) >= size),
g AS (SELECT doc, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS gram FROM p),
o AS (SELECT doc, pos, size, item_id FROM g JOIN win USING (size, gram)),
h AS (SELECT doc, count(DISTINCT word) AS n_hit FROM (SELECT doc, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT doc, pos, size FROM o)) GROUP BY doc),
i AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc, item_id::VARCHAR AS item FROM o) GROUP BY doc)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc) LEFT JOIN i USING (doc)
"""
