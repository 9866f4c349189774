"""Toxicity by noisy-channel deobfuscation.

What a writer meant is decoded from what stands there: a token with look-alike characters, with characters drawn out
or a row of spaced single characters becomes a lattice (each character as itself or as the letters it may stand for,
a run as one, two or all of its characters, a separator as a word break or as nothing), and Viterbi's algorithm finds
the path of least cost under a character trigram model plus the costs of the channel. Tokens of letters alone have a
one-path lattice and stay. The restored words are scored: words and their five-character pieces carry weights (lower
confidence bounds of the log-odds of standing in toxic documents), a document's evidence is its three strongest pieces and
the sum of all others, and a logistic calibration turns evidence and length into a probability. Evidence for the calibration
comes from weights of the other half of the labelled documents.

The character model counts the trigrams of all documents, in a fixed number of cells by a hash (so that it may be
broadcast whatever scripts the corpus has, and no trigram is left out); weights are learned from a bounded sample of
labelled documents, of which all pieces with a weight are kept.

Defined cases: null counts as empty; an empty text has no evidence and gets the calibrated score of that; without
labels of both classes every score is the share of toxic labels (0 without labels); conflicting labels of one id count
as toxic; repeated rows give repeated rows; an empty table gives none; columns other than those named are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.arrays import logistic, sigmoid
from graphmill.llm.common import bounded, text_of, written

#: What a character may stand for: fixed values.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
SEPARATORS = " \t.-_*/~'`,"
#: Costs of the channel, in nats.
LOOKALIKE_COST, RUN_COST, DROP_COST = 1.0, 0.5, 0.3
#: Characters that only decorate a token's ends.
EDGE = ".,;:?\"'()[]{}<>*#%&~^`_-=/\\«»“”‘’…"
#: At most so many labelled documents of each class are learned from, chosen by a hash of the id.
TRAIN_DOCS = {1: 6000, 0: 12000}
#: Characters of a piece, and toxic documents of the sample that a piece must stand in before it says anything.
PIECE, LEAST_DOCS = 5, 3
#: Cells of the character model: trigrams, their first two and last two characters, their second and third character.
CELLS = (1 << 20, 1 << 17, 1 << 17, 1 << 14, 1 << 14)
THRESHOLD = 0.7
#: Heaviest pieces of a text that count one by one; the others count by their sum.
STRONGEST = 3
#: Figures of a text: its strongest pieces, the sum of the others, the logarithm of one more than its tokens.
FIGURES = STRONGEST + 2
#: Tokens whose score a worker keeps; the table starts anew beyond that, which changes no result.
KEPT = 400_000

SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ \t.\-_*/~]{1,3}(?:[^\W_]|[@$!|+])){2,}(?![^\s.,;:!?])")
DRAWN_OUT = re.compile(r"(.)\1\1")
TAIL = re.compile(r"(?:[!$@+|€£¡]{2,}|!+)$")
HEAD = re.compile(r"^[!$@+|€£¡]{2,}")


def core(token: str) -> str:
    """A token without the marks that decorate its ends."""
    last = None
    while token != last:
        last = token
        token = HEAD.sub("", TAIL.sub("", token.strip(EDGE)))
    return token


def cells_of(trigram: str) -> tuple[int, ...]:
    """Where a trigram is counted: one cell of each kind, all kinds one after the other."""
    out, begin = [], 0
    for part, size in zip((trigram, trigram[:2], trigram[1:], trigram[1], trigram[2]), CELLS):
        out.append(begin + zlib.crc32(part.encode("utf-8", "surrogatepass")) % size)
        begin += size
    return tuple(out)


class CharModel:
    """Character trigrams with two levels of back-off; a blank is the word break. ``counts``: all cells."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros(sum(CELLS), np.int64) if counts is None else counts
        self.total = int(self.counts[-CELLS[-1] :].sum())
        self.costs: dict[str, float] = {}

    def __getstate__(self):
        return self.counts

    def __setstate__(self, counts):
        self.__init__(counts)

    @classmethod
    def of(cls, trigrams: dict[str, int]) -> CharModel:
        counts = np.zeros(sum(CELLS), np.int64)
        for t, n in trigrams.items():
            counts[list(cells_of(t))] += n
        return cls(counts)

    def cost(self, trigram: str) -> float:
        if (found := self.costs.get(trigram)) is None:
            n3, c2, n2, c1, n1 = self.counts[list(cells_of(trigram))].tolist()
            p = (n1 + 1) / (self.total + 1000)
            p = (n2 + 5 * p) / (c1 + 5)
            p = (n3 + 5 * p) / (c2 + 5)
            found = self.costs[trigram] = -math.log(min(p, 1.0))  # cells are shared, so a sum may be short
            if len(self.costs) > 500_000:
                self.costs.clear()
        return found

    @staticmethod
    def trigrams(words: dict[str, int]) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            padded = f"  {w} "
            for k in range(len(padded) - 2):
                out[padded[k : k + 3]] += n
        return out


def arcs(text: str, k: int) -> Iterator[tuple[int, str, float]]:
    """Lattice arcs that begin at position k: (end, what is meant, cost of the channel)."""
    ch, end = text[k], k + 1
    while end < len(text) and text[end] == ch:
        end += 1
    if ch in SEPARATORS:
        yield end, " ", 0.0
        yield end, "", DROP_COST
        return
    meant = [(ch, 0.0)] if ch.isalnum() else []
    meant += [(c, LOOKALIKE_COST) for c in LOOKALIKES.get(ch, "")]
    if not meant:
        yield k + 1, " ", 0.0
        return
    for c, cost in meant:
        yield k + 1, c, cost
        if end - k >= 3:
            yield end, c, cost + RUN_COST
            yield end, c + c, cost + RUN_COST


def viterbi(text: str, model: CharModel) -> str:
    """The most likely intended text: words with single blanks between them."""
    states: list[dict[str, tuple[float, tuple]]] = [{} for _ in range(len(text) + 1)]
    states[0]["  "] = (0.0, ())
    for k in range(len(text)):
        here, states[k] = states[k], {}
        if not here:
            continue
        for end, meant, channel in arcs(text, k):
            there = states[end]
            for context, (cost, path) in here.items():
                cost, now = cost + channel, context
                for c in meant:
                    if c == " " and now[1] == " ":
                        now = "  "
                        continue
                    cost += model.cost(now + c)
                    now = now[1] + c if c != " " else "  "
                if now not in there or cost < there[now][0]:
                    there[now] = (cost, (path, meant) if meant else path)
    best = min(((cost + (model.cost(context + " ") if context[1] != " " else 0), context, path) for context, (cost, path) in states[-1].items()), key=lambda s: s[:2])
    out, path = [], best[2]
    while path:
        path, meant = path
        out.append(meant)
    return " ".join("".join(reversed(out)).split())


def restored(token: str, model: CharModel) -> str:
    """What a lower-case token means; tokens without letters are no words and give an empty string."""
    token = core(token)
    if token.isalpha() and not DRAWN_OUT.search(token):
        return token
    if not any(c.isalpha() for c in token):
        return ""
    return viterbi(token, model)


def restore_text(text: str, model: CharModel) -> str:
    """The whole text in lower case with obfuscated parts restored."""
    text = SPACED.sub(lambda m: viterbi(m.group(), model), text.lower())
    return re.sub(r"\S+", lambda m: restored(m.group(), model) or m.group(), text)


def words_of(text: str, model: CharModel, kept: dict[str, tuple[str, ...]]) -> Iterator[str]:
    """The restored words of a text, as a stream that may repeat words."""
    lower = text.lower()
    for m in SPACED.finditer(lower):
        yield from viterbi(m.group(), model).split()
    for token in set(lower.split()):
        if (found := kept.get(token)) is None:
            if len(kept) > KEPT:
                kept.clear()
            found = kept[token] = tuple(restored(token, model).split())
        yield from found


def pieces(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked, *(marked[k : k + PIECE] for k in range(len(marked) - PIECE + 1))}


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    coefficients: np.ndarray
    kept: dict[str, tuple[float, str] | None] = field(default_factory=dict)

    def _token(self, words: list[str]) -> tuple[float, str] | None:
        """The heaviest piece of a token's words."""
        get, best = self.weights.get, None
        for w in words:
            for p in pieces(w):
                if (x := get(p)) is not None and (best is None or (x, p) > best):
                    best = (x, p)
        return best

    def evidence(self, text: str) -> list[float]:
        """The ``FIGURES`` of a text: strongest pieces first, falling, filled up with zeros. A token counts with one
        piece, a piece once."""
        lower, kept, hits = text.lower(), self.kept, {}
        for m in SPACED.finditer(lower):
            if found := self._token(viterbi(m.group(), self.chars).split()):
                hits[found[1]] = found[0]
        tokens = lower.split()
        for token in set(tokens):
            if token in kept:
                found = kept[token]
            else:
                if len(kept) > KEPT:
                    kept.clear()
                found = kept[token] = self._token(restored(token, self.chars).split())
            if found:
                hits[found[1]] = found[0]
        top = heapq.nlargest(STRONGEST, hits.values())
        rest = math.fsum(hits.values()) - math.fsum(top)
        return [*top, *[0.0] * (STRONGEST - len(top)), math.log1p(max(0.0, rest)), math.log1p(len(tokens))]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(evidence))
        return sigmoid(np.column_stack([evidence.reshape(len(evidence), FIGURES), np.ones(len(evidence))]) @ self.coefficients)

    def __getstate__(self):
        return (self.chars, self.weights, self.coefficients)

    def __setstate__(self, state):
        self.chars, self.weights, self.coefficients = state
        self.kept = {}


def _bound(pos: str, neg: str, positives: int, negatives: int) -> F.Column:
    """Lower confidence bound of the log-odds of a piece."""
    p, n = F.col(pos) + 0.5, F.col(neg) + 0.5
    return F.log(p / n) - math.log((positives + 1) / (negatives + 1)) - 2 * F.sqrt(1 / p + 1 / n)


def char_model(texts: DataFrame) -> CharModel:
    """Trigrams of all rows of ``texts`` (column ``text``). A task holds one array of cells and the trigrams of a batch;
    what comes to the driver has a row for each cell at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = np.zeros(sum(CELLS), np.int64), {}
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(text.lower().split())
            plain: Counter = Counter()
            for w, n in words.items():
                plain[core(w)] += n
            found = CharModel.trigrams(plain)
            if len(places) > KEPT:
                places.clear()
            for t in found.keys() - places.keys():
                places[t] = cells_of(t)
            if found:
                at = np.array([places[t] for t in found])
                np.add.at(total, at.ravel(), np.repeat(np.fromiter(found.values(), np.int64, len(found)), len(CELLS)))
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(sum(CELLS), np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return CharModel(counts)


def _piece_counts(texts: DataFrame, chars: CharModel) -> DataFrame:
    """``piece, p0, n0, p1, n1``: documents with the piece, by label and half."""
    shared = texts.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            counts: list[Counter] = [Counter() for _ in range(4)]
            for text, label, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found: set[str] = set()
                for w in words_of(text, shared.value, kept):
                    found |= pieces(w)
                counts[2 * half + (label == 0)].update(found)
            for k, c in enumerate(counts):
                yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["piece", "k", "n"])

    raw = texts.select("text", "label", "half").mapInArrow(run, "piece string, k int, n long")
    return raw.groupBy("piece").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in enumerate(("p0", "n0", "p1", "n1"))])


def train(docs: DataFrame, labels: DataFrame, train_docs: dict[int, int] = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """``labels`` has the id and the label of what may be learned from; what is chosen of it is bounded."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    everything = sum(totals.values())
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, everything)
        flat = None if share == 0 else np.array([*[0.0] * FIGURES, 30.0])
        return Model(CharModel(), {}, flat)
    chosen = bounded(known, "label", train_docs, totals, "toxic")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.withColumn("digest", F.xxhash64("text")).dropDuplicates(["digest", "label"]).withColumn("half", F.pmod("digest", F.lit(2)).cast("int"))
    texts = written(texts.select("text", "label", "half"), "toxicity-sample")
    sizes = {(r[0], r[1]): r[2] for r in texts.groupBy("label", "half").count().collect()}
    of = lambda y, h: sizes.get((y, h), 0)
    chars = char_model(docs.select(text_of(text_col).alias("text")))
    p, n = sum(of(1, h) for h in (0, 1)), sum(of(0, h) for h in (0, 1))
    counted = _piece_counts(texts, chars).withColumn("p", F.col("p0") + F.col("p1")).withColumn("n", F.col("n0") + F.col("n1")).filter(F.col("p") >= LEAST_DOCS)
    bounds = counted.select("piece", _bound("p", "n", p, n).alias("w"), _bound("p0", "n0", of(1, 0), of(0, 0)).alias("w0"), _bound("p1", "n1", of(1, 1), of(0, 1)).alias("w1"))
    found = bounds.filter("greatest(w, w0, w1) > 0.5").collect()
    weights = [{r["piece"]: r[name] for r in found if r[name] > 0.5} for name in ("w0", "w1", "w")]
    halves = [Model(chars, w, None) for w in weights[:2]]
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value[1 - half].evidence(text) for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["label", "evidence"])

    seen = texts.select("text", "half", "label").mapInArrow(crossed, "label int, evidence array<double>").toPandas()
    y = seen["label"].to_numpy()
    if len(set(y)) < 2:  # the texts of a class are gone
        share = totals[1] / everything
        return Model(chars, weights[2], np.array([*[0.0] * FIGURES, math.log(share / (1 - share))]))
    x = np.stack(seen["evidence"])
    share = np.array([totals[0] / everything / max(1e-9, (y == 0).mean()), totals[1] / everything / max(1e-9, (y == 1).mean())])
    order = np.lexsort([*x.T, y])  # the same for any partitioning
    x, y = x[order], y[order]
    return Model(chars, weights[2], logistic(x, y, share[y], ridge=1e-4))


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, evidence``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = np.array([shared.value.evidence(t.as_py()) for t in batch.column(1)], np.float64).reshape(batch.num_rows, FIGURES)
            score = shared.value.score(evidence)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(evidence[:, 0])], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, evidence double")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = np.array([shared.value.evidence(t.as_py() or "") for t in batch.column(at)], np.float64)
            score = shared.value.score(evidence.reshape(batch.num_rows, FIGURES))
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def deobfuscate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: the texts in lower case with obfuscated parts restored."""
    shared = docs.sparkSession.sparkContext.broadcast(model.chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([restore_text(t.as_py(), shared.value) for t in batch.column(1)], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, text string")
