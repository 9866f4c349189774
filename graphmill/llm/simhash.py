"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where more than half of the XXH64 hashes of its word shingles have it set.
Two fingerprints link if they differ in at most four bits.

The 64 bits are cut in three segments (22, 21, 21), each a word of the perfect binary Golay code [23, 12, 7]. A
segment's indices are those of the codewords to which it and its one-bit neighbours decode; words at distance two or less
have a neighbour in common and so an index. Of four errors either at most two fall on each segment, and then the two
fingerprints share an index in all three; or three or four fall on one, and then of the other two segments one is the
same and the other differs in one bit at most. So a fingerprint gets a key for each choice of an index in all three
segments (36 bits), and for each of the six ordered pairs of segments one for the first as it is and each index of the
second (33 bits or more): some 180 keys. The fingerprints of a key are compared, and every link is verified on all
64 bits. Nothing is missed.

Only different fingerprints are compared, and a key with many of them emits a spanning forest of its links rather
than all pairs. Keys with more than ``BLOCK`` fingerprints, as counted on a fixed share of the fingerprints with all their
keys, are split in blocks that are compared pair by pair; an error in that count costs time, never a link.

Defined cases: null counts as empty; a text without words has fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows share a component; the component id is the least non-null
id (null if there is none); an empty table gives no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import text_of, written
from graphmill.llm.skew import components, join_labels

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Width and lowest bit of each segment.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
PAIRS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))
#: Generator polynomial of the Golay code, a fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Fingerprints of one key that are compared in one task; at most so many hot keys are held by the driver; one of so many
#: fingerprints is counted to find hot keys.
BLOCK, HOT_KEYS, COUNTED = 4096, 10_000, 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and exactly \\x20 and \\x09-\\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end[shingle - 1 :].tolist())), "<u8", len(start))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        part = h[k : k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """``doc_id, fp, text_sha256, row``: the fingerprint's 64 bits as a signed long, the digest (32 bytes) that tells texts
    of one id apart, and the number ``row_col`` of the row (null if none is named) that tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            digest = pa.array([hashlib.sha256(t.as_py()).digest() for t in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64)), digest, batch.column(2)], ["doc_id", "fp", "text_sha256", "row"])

    row = F.lit(None) if row_col is None else F.col(row_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"), row.cast("long").alias("row"))
    return named.mapInArrow(run, "doc_id long, fp long, text_sha256 binary, row long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the upper 12 bits, and the error (at most three bits) of each of the 2048 syndromes."""
    upper = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        upper = np.where(upper >> bit & 1, upper ^ GENERATOR << bit - 11, upper)
    one = 1 << np.arange(23, dtype=np.int64)
    two = (one[:, None] | one).ravel()
    error = np.zeros(2048, np.int64)
    for e in ((two[:, None] | one).ravel(), two, one, np.zeros(1, np.int64)):  # fewer errors last
        error[upper[e >> 11] ^ e & 2047] = e
    return upper, error


SYNDROME, ERROR = _golay()


def decode(word: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (word ^ ERROR[SYNDROME[word >> 11] ^ word & 2047]) >> 11


def segment_keys(fp: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of the segment's ball of radius one: (n, width + 1) sorted, and which of them are new."""
    width, low = SEGMENTS[segment]
    word = (fp >> np.uint64(low)).astype(np.int64) & (1 << width) - 1
    keys = np.sort(decode(word[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])), axis=1)
    return keys, np.concatenate([np.ones((len(fp), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)


def _product(left: np.ndarray, at: np.ndarray, keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``left`` (of the fingerprints ``at``) with every key of its fingerprint (``many`` each) behind it."""
    times, first = many[at], np.cumsum(many) - many
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = np.repeat(at, times)
    return np.repeat(left, times) << 12 | keys[first[at] + inner], at


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys, and for each the position of its fingerprint."""
    found = []
    for segment in range(len(SEGMENTS)):
        keys, new = segment_keys(fp, segment)
        found.append((keys[new], new.sum(axis=1)))
    key, at = np.zeros(len(fp), np.int64), np.arange(len(fp))
    for keys, many in found:
        key, at = _product(key, at, keys, many)
    out_key, out_at = [key], [at]
    for n, (i, j) in enumerate(PAIRS):
        width, low = SEGMENTS[i]
        key, at = _product((fp >> np.uint64(low)).astype(np.int64) & (1 << width) - 1, np.arange(len(fp)), *found[j])
        out_key.append(n + 1 << 36 | key)
        out_at.append(at)
    return np.concatenate(out_key), np.concatenate(out_at)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 2048):
                key, at = keys_of(fp[k : k + 2048].view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(fp[k + at])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``fp``: each link found is searched from one end against what is not yet
    reached, so a dense group costs little more than its size."""
    a, b, rest = [], [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _distance(rest, x) <= DISTANCE
            if near.any():
                reached, rest = rest[near], rest[~near]
                a.append(np.full(len(reached), x))
                b.append(reached)
                queue += list(reached)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole groups; ``key`` is sorted."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    a, b = [], []
    for k in np.flatnonzero(size > 24).tolist():
        x, y = _forest(np.unique(fp[edge[k] : edge[k + 1]]))
        a.append(x)
        b.append(y)
    few = np.repeat(size <= 24, size)
    key, fp = key[few], fp[few]
    for step in range(1, 24):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        near = same[_distance(fp[same], fp[same + step]) <= DISTANCE]
        a.append(fp[near])
        b.append(fp[near + step])
    if not a:
        return fp[:0], fp[:0]
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; the last key of a batch waits for the next batch."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(key) and key[0] != key[-1]:
            done = np.searchsorted(key, key[-1])
            a, b = _linked(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
    if len(key):
        a, b = _linked(key, fp)
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: enough verified links between the different fingerprints of ``fps`` to connect all that are linked."""
    spark = fps.sparkSession
    counted = fps.filter(F.pmod(F.xxhash64("fp", F.lit("hot")), F.lit(COUNTED)) == 0)
    many = _keyed(counted).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * COUNTED * 2 > BLOCK)
    many = many.select("key", F.ceil(F.col("n") * COUNTED / BLOCK).cast("int").alias("blocks"))
    keyed = _keyed(fps)
    hot = many.limit(HOT_KEYS + 1).collect()
    if hot:
        side = F.broadcast(spark.createDataFrame(hot, many.schema)) if len(hot) <= HOT_KEYS else many
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.shiftleft(F.least(block, other).cast("long"), 32) + F.greatest(block, other))
        keyed = keyed.join(side, "key", "left").select(
            F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(groups)).alias("part"), "key", "fp"
        ).select(F.when(F.col("part") < 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), "fp")  # keys that fall together cost comparisons only
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``doc_id, fp, text_sha256, row``, fingerprints ``fp, n, root`` and components ``root, component_id, ...``."""
    rows = written(fingerprints(docs, id_col, text_col, shingle, row_col), "fingerprints")
    of_fp = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    root = components(links(of_fp.select("fp"))).select(F.col("node").alias("fp"), "root")
    of_fp = written(of_fp.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-fingerprints")
    of_root = of_fp.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("fps"))
    return rows, of_fp, of_root


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: ``doc_id, fingerprint, component_id, component_size``."""
    rows, of_fp, of_root = _labelled(docs, id_col, text_col, shingle)
    labels = join_labels(of_fp.select("fp", "n", "root"), of_root, "root", "fps", of_fp.count()).select("fp", "n", "component_id", "component_size")
    out = join_labels(rows.select("doc_id", "fp"), labels, "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """``doc_id, text_sha256, row`` of one document of each component: that with the least id (a null id only where all are
    null), of rows that share the id that with the least digest, and of those that share both the least ``row_col``."""
    rows, of_fp, _ = _labelled(docs, id_col, text_col, shingle, row_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256", "row")).alias("own")
    own = rows.groupBy("fp").agg(first).join(of_fp.select("fp", "root"), "fp").groupBy("root").agg(F.min("own").alias("own"))
    return own.select("own.doc_id", "own.text_sha256", "own.row")
