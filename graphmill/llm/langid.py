"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree of depth ``order``: counts of the byte that follows each context
of 0 to ``order`` bytes. The statistics are frozen after training. The code length of a byte is that of PPM with
escape method C and full exclusion: the longest known context codes the byte if it has seen it, or else codes an
escape and hands over to the context shorter by one byte, without the bytes already ruled out; below order 0 the rest
of the 256 bytes are equally likely. Because what follows a context also follows its suffixes, all exclusions are
sums over a context's own followers, so code lengths come out of array look-ups. A text belongs to the language that
codes it shortest.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything where there is nothing
to learn from; equal code lengths go to the first language by name; very long texts are scored whole; repeated rows
give repeated rows; an empty table gives none; columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.arrays import HashIndex, slices
from graphmill.llm.common import bounded, text_of, written

ORDER = 3
#: At most so many documents of each language are learned from, chosen by a hash of the id.
TRAIN_DOCS = 3000
#: Bytes scored at a time.
SLICE = 4_000_000


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (order + 1)-grams, one for each byte of the texts one after the other (a text begins after ``order``
    zero bytes), and where each text begins among them."""
    pad = bytes(order)
    raw = np.frombuffer(pad.join([b"", *texts]), np.uint8).astype(np.int64)
    code = raw.copy()
    for k in range(1, order + 1):
        code[k:] |= raw[:-k] << 8 * k
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    real = np.ones(len(raw), bool)
    first = np.cumsum(size + order) - (size + order)
    for k in range(order):
        real[first + k] = False
    return code[real], np.cumsum(size) - size


class Tree:
    """Context tree of one language, from the counts of its (order + 1)-grams."""

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int):
        self.order, self.of_gram, self.of_context = order, [None] * (order + 1), [None] * (order + 1)
        for k in range(order, -1, -1):
            code, at = np.unique(code & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            count = np.bincount(at, count).astype(np.int64)
            self.of_gram[k] = (code, count)
        for k in range(order + 1):
            code, count = self.of_gram[k]
            context, at = np.unique(code >> 8, return_inverse=True)
            shorter = self._count(code, k - 1) if k else np.zeros(len(code), np.int64)
            self.of_context[k] = (context, np.bincount(at, count), np.bincount(at), np.bincount(at, shorter))

    def _count(self, code: np.ndarray, k: int) -> np.ndarray:
        known, count = self.of_gram[k]
        code = code & (1 << 8 * (k + 1)) - 1
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[at] == code, count[at], 0)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each (order + 1)-gram after the bytes before it."""
        out, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        less_n, less_d = np.zeros(len(code)), np.zeros(len(code))
        for k in range(self.order, -1, -1):
            context, total, kinds, shorter = self.of_context[k]
            own = (code & (1 << 8 * (k + 1)) - 1) >> 8
            at = np.minimum(np.searchsorted(context, own), len(context) - 1)
            known = context[at] == own
            n = self._count(code, k)
            escape = kinds[at] - less_d
            scale = np.maximum(total[at] - less_n + escape, 1e-9)
            hit, miss = open_ & known & (n > 0), open_ & known & (n == 0) & (escape > 0)
            out[hit] += np.log2(scale[hit] / n[hit])
            out[miss] += np.log2(scale[miss] / escape[miss])
            open_ &= ~hit
            less_n, less_d = np.where(known, shorter[at], 0), np.where(known, kinds[at], 0)
        out[open_] += np.log2(np.maximum(256 - less_d[open_], 1))
        return out


class Model:
    """Trees of all languages and the table of the code lengths of the grams that they know."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = sorted(counts), order
        self.trees = [Tree(*counts[name], order) for name in self.languages]
        known = np.unique(np.concatenate([t.of_gram[order][0] for t in self.trees])) if self.trees else np.empty(0, np.int64)
        self.index, self.table = HashIndex(known), [t.bits(known) for t in self.trees]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits."""
        out = np.zeros((len(texts), len(self.trees)))
        full = np.array([k for k, t in enumerate(texts) if t], np.int64)
        if not len(full):
            return out
        code, start = grams([texts[k] for k in full], self.order)
        at = self.index.find(code)
        strange = np.flatnonzero(at < 0)
        new, back = np.unique(code[strange], return_inverse=True)
        for k, tree in enumerate(self.trees):
            bits = self.table[k].take(at)
            if len(strange):
                bits[strange] = tree.bits(new)[back]
            out[full, k] = np.add.reduceat(bits, start)
        return out


def gram_counts(docs: DataFrame, order: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, code, n`` over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [len(t.as_py()) for t in whole.column(1)]
            for a, b in slices(sizes, SLICE):
                by: dict[str, list[bytes]] = {}
                for name, text in zip(whole.column(0).slice(a, b - a).to_pylist(), whole.column(1).slice(a, b - a).to_pylist()):
                    by.setdefault(name, []).append(text)
                for name, texts in by.items():
                    code, n = np.unique(grams(texts, order)[0], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).cast("binary").alias("text")).filter("lang is not null")
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from ``train_docs`` documents of each language, those whose ids have the least hashes (all where there are
    no more). Of rows that repeat an id and a language one is learned from."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text")).filter("lang is not null")
    named = written(known.select("id", "lang").distinct(), "languages")  # an id that repeats counts once, here and in the bound
    sizes = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    if not sizes:
        return Model({}, order)
    chosen = bounded(named, "lang", dict.fromkeys(sizes, train_docs), sizes, "lang")
    texts = known.join(F.broadcast(chosen), ["id", "lang"]).dropDuplicates(["id", "lang"])
    found = gram_counts(texts, order).toPandas()
    return Model({name: (g["code"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for name, g in found.groupby("lang")}, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte``: the score is the language's posterior at equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for a, b in slices([len(t.as_py()) for t in whole.column(1)], SLICE):
                batch = whole.slice(a, b - a)
                texts, letters = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
                bits = model.code_lengths(texts)
                if not model.trees:
                    bits, letters = np.zeros((len(texts), 1)), np.zeros(len(texts), bool)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(texts)), best]
                score = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                size = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)
                names = [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(least / size)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"), text_of(text_col).rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
