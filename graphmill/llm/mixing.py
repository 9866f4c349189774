"""Mixing documents to target weights of soft domains.

The domains are the classes of a table of labels. A classifier learned from the labelled documents gives every document
a posterior over the domains. Rates (expected numbers of copies, not negative) are fitted so that the expected tokens
of every domain, the sum over documents of rate * tokens * posterior, meet the targets: least squares by projected
gradient with momentum from rates of one, where a document's step is scaled by its length so that texts of the same posterior get
the same rate. An iteration is one aggregation of as many sums as there are domains; the rates themselves are never
collected, for they follow from the posteriors and the (few, short) gradients so far. Rows may have a least rate, on
which they are projected instead of 0. Steps end when the targets are met or come no nearer, and the result says which.

The classifier is a softmax over evidence from hashed words: for each domain the mean and the largest of its words'
log-odds. Word statistics come from one half of the chosen documents and the softmax from the other.

Defined cases: null counts as empty; a text without words has no tokens, the posterior of no evidence and a rate like
any other; without labels there is one domain and every rate is budget / tokens; a domain that no document belongs to
is left out of the targets; repeated rows are rows of their own; an empty table gives no rows; columns other than the
id, the text and the labels are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.arrays import slices
from graphmill.llm.common import bounded, text_of, written
from graphmill.llm.words import word_hashes

#: At most so many labelled documents of each domain are learned from, chosen by a hash of the id.
TRAIN_DOCS = 3000
#: Word hashes share so many cells.
CELLS = 1 << 18
SLICE = 2_000_000
#: Steps at most, steps without a better result after which targets count as out of reach, steps after which rates are
#: written, and how near (as a share of all tokens) a target is met.
ITERATIONS, PATIENCE, WRITTEN, TOLERANCE = 200, 30, 20, 1e-4


def _features(texts: list[bytes], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and mean and largest log-odds of each domain, for each text."""
    h, n = word_hashes(texts)
    x = np.zeros((len(texts), 2 * odds.shape[0]))
    full = np.flatnonzero(n)
    if len(full):
        cell, start = (h % np.uint64(CELLS)).astype(np.int64), (np.cumsum(n) - n)[full]
        for d, table in enumerate(odds):
            own = table.take(cell)
            x[full, 2 * d] = np.add.reduceat(own, start) / n[full]
            x[full, 2 * d + 1] = np.maximum.reduceat(own, start)
    return n, x


@dataclass
class Classifier:
    domains: list[str]
    odds: np.ndarray
    weights: np.ndarray

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, x = _features(texts, self.odds)
        z = np.column_stack([x, np.ones(len(x))]) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return n, z / z.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """Weighted multinomial logistic regression with a small ridge, by damped Newton steps on one class at a time."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = np.column_stack([x / scale, np.ones(len(x))])
    w, target = np.zeros((x.shape[1], classes)), np.eye(classes)[y]
    ridge = 1e-4 * weight.sum() * np.eye(x.shape[1])
    for _ in range(60):
        for k in range(classes):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True))[:, k]
            step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weight * (target[:, k] - p)) - ridge @ w[:, k])
            w[:, k] += np.clip(step, -4, 4)
    w[:-1] /= scale[:, None]
    return w


def train(docs: DataFrame, labels: DataFrame, domain: Column, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """``domain``: the name of the class of a row of ``labels``; of several labels of an id the first name holds."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), domain.alias("domain")).filter("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    # shares of the documents that there are: an earlier stage may have removed most of a domain
    known = written(known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi"), "mixing-labels")
    totals = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    names = sorted(totals)
    if len(names) < 2:
        return Classifier(names or ["all"], np.zeros((1, CELLS)), np.zeros((3, 1)))
    chosen = bounded(known, "domain", dict.fromkeys(names, train_docs), totals, "domain")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    texts = written(texts.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).select("text", "domain", "half"), "mixing-sample")
    # a domain whose documents are gone (an earlier stage may have removed them) cannot be learned
    sizes = {(r[0], r[1]): r[2] for r in texts.groupBy("domain", "half").count().collect()}
    names = [name for name in names if sizes.get((name, 0)) and sizes.get((name, 1))]
    if len(names) < 2:
        return Classifier(names or ["all"], np.zeros((1, CELLS)), np.zeros((3, 1)))
    texts = texts.filter(F.col("domain").isin(names))
    number = {name: k for k, name in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each cell, by domain."""
        total = np.zeros((len(number), CELLS), np.int64)
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist()):
                total[number[name], np.unique((word_hashes([text.as_py()])[0] % np.uint64(CELLS)).astype(np.int64))] += 1
        d, cell = np.nonzero(total)
        yield pa.record_batch([pa.array(d), pa.array(cell), pa.array(total[d, cell])], ["d", "cell", "n"])

    counts = texts.filter("half = 0").select("text", "domain").mapInArrow(counted, "d long, cell long, n long").groupBy("d", "cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(names), CELLS))
    n[counts["d"], counts["cell"]] = counts["n"]
    size = np.array([sizes[name, 0] for name in names], np.float64)
    rest, rest_size = n.sum(axis=0) - n, size.sum() - size
    # lower bounds of the log-odds of being in a document of the domain against the others
    odds = np.log((n + 0.5) / (rest + 0.5)) - np.log((size + 1) / (rest_size + 1))[:, None]
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - 1.5 * np.sqrt(1 / (n + 0.5) + 1 / (rest + 0.5)))
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = np.concatenate([_features(texts[a:b], shared.value)[1] for a, b in slices([len(t) for t in texts], SLICE)])
            yield pa.record_batch([batch.column(1), pa.array(list(x))], ["domain", "x"])

    rows = texts.filter("half = 1").select("text", "domain").mapInArrow(seen, "domain string, x array<double>").toPandas()
    y, x = rows["domain"].map(number).to_numpy(), np.stack(rows["x"])
    order = np.lexsort([*x.T, y])  # the same for any partitioning
    y, x = y[order], x[order]
    share = np.array([totals[name] / sum(totals[other] for other in names) / (y == k).mean() for name, k in number.items()])
    return Classifier(names, odds, _softmax_fit(x, y, share[y], len(names)))


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, tokens, p`` (an array in the order of ``model.domains``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices([len(t.as_py()) for t in whole.column(1)], SLICE):
                batch = whole.slice(a, b - a)
                n, p = shared.value.posteriors(batch.column(1).to_pylist())
                yield pa.record_batch([batch.column(0), pa.array(n), pa.array(list(p))], ["doc_id", "tokens", "p"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, tokens long, p array<double>")


def _state(history: list[np.ndarray], r: Column, y: Column, least: Column) -> Column:
    """A row after some steps from ``r, y``: its rate, and the point ahead of it at which the next gradient is taken. A
    step goes from y against the gradient, is projected on rates that are at least ``least``, and y moves beyond the new
    rate by the step's momentum (the last number of a step)."""
    start = F.struct(r.alias("r"), y.alias("y"))
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in h]) for h in history])
    last = len(history[0]) - 1

    def move(s: Column, h: Column) -> Column:
        r = F.greatest(least, s["y"] - sum((F.col("p")[d] * h[d] for d in range(1, last)), F.col("p")[0] * h[0]))
        return F.struct(r.alias("r"), (r + h[last] * (r - s["r"])).alias("y"))

    return F.aggregate(steps, start, move)


@dataclass
class Fit:
    domains: list[str]
    tokens: np.ndarray
    targets: np.ndarray
    reached: np.ndarray
    history: list[np.ndarray]
    least: Column

    @property
    def met(self) -> bool:
        """Whether all targets are met; else the rates are the nearest that were found."""
        return bool(np.abs(self.reached - self.targets).max(initial=0) <= TOLERANCE * max(self.targets.sum(), 1e-9))

    def rate(self) -> Column:
        return _state(self.history, F.lit(1.0), F.lit(1.0), self.least)["r"]


def fit(parts: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None, least: Column | None = None) -> Fit:
    """Fit rates on rows ``tokens, p``. ``budget``: tokens of the mix (as many as there are by default). ``least``: the least
    rate of a row, from 0 to 1, by its ``p``."""
    least = (F.lit(0.0) if least is None else least).cast("double")
    size = range(len(domains))
    sums = [F.sum(F.col("tokens") * F.col("p")[d]).alias(f"t{d}") for d in size]
    gram = [F.sum(F.col("tokens") * F.col("p")[d] * F.col("p")[e]).alias(f"g{d}_{e}") for d in size for e in size]
    row = parts.agg(*sums, *gram).first()
    now = np.array([row[f"t{d}"] or 0.0 for d in size])
    g = np.array([[row[f"g{d}_{e}"] or 0.0 for e in size] for d in size])
    w = np.array([max(0.0, weights.get(name, 0.0)) for name in domains]) * (now > 0)
    if not w.sum():
        w = now.copy()
    if not now.sum():
        return Fit(domains, now, now, now, [], least)
    w /= w.sum()
    if budget is None:
        budget = float(now.sum())
    target = budget * w
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-12 * np.trace(g)))  # rows of equal norm
    step = 1 / np.linalg.eigvalsh(scale[:, None] * g * scale).max()
    history: list[np.ndarray] = []
    reached = ahead = now
    best, best_at = np.inf, 0
    state, recent = parts.select("tokens", "p", F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), []
    for k in range(ITERATIONS):
        off = np.abs(reached - target).max()
        if off < 0.999 * best:
            best, best_at = off, k
        if off <= TOLERANCE * budget or k - best_at > PATIENCE:
            break
        history.append(np.append(step * scale**2 * (ahead - target), k / (k + 3)))
        recent.append(history[-1])
        moved = state.select("tokens", "p", _state(recent, F.col("r"), F.col("y"), least).alias("s"))
        if len(recent) == WRITTEN:
            state, recent = written(moved.select("tokens", "p", "s.r", "s.y"), "mixing-rates"), []
            moved = state.select("tokens", "p", F.struct("r", "y").alias("s"))
        row = moved.agg(*[F.sum(F.col(f"s.{at}") * F.col("tokens") * F.col("p")[d]).alias(f"{at}{d}") for at in "ry" for d in size]).first()
        reached, ahead = (np.array([row[f"{at}{d}"] for d in size]) for at in "ry")
    return Fit(domains, now, target, reached, history, least)


def copies(rate: Column, key: Column) -> Column:
    """A whole number of copies whose expectation is the rate, by a hash of the key."""
    return (F.floor(rate) + (F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate - F.floor(rate)).cast("long")).cast("long")


def largest_bound(parts: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None, least: Column) -> float:
    """A factor (0 to 1) beyond which ``least``, multiplied by it, makes the targets unreachable.

    What the least rates leave of the targets has to be a combination of rows with rates of 0 or more, so in no direction u
    can its mean lie beyond the row that lies farthest: u (T - f B) <= max(u p) * |T - f B|, with T the targets and B the least
    tokens. That bounds f for each direction; one aggregation serves all."""
    size = range(len(domains))
    if len(domains) <= 4:
        directions = [u for u in product((-1, 0, 1, 3), repeat=len(domains)) if len(set(u)) > 1]
    else:
        directions = [tuple(int(d == i) - int(d == j) for d in size) for i in size for j in size if i != j]
    full = parts.filter("tokens > 0")
    far = [F.max(sum((F.col("p")[d] * u[d] for d in size), F.lit(0.0))) for u in directions]
    row = full.agg(*[F.sum(F.col("tokens") * F.col("p")[d]) for d in size], *[F.sum(F.col("tokens") * F.col("p")[d] * least) for d in size], *far).first()
    values = np.array([x or 0.0 for x in row])
    now, held, far = values[: len(domains)], values[len(domains) : 2 * len(domains)], values[2 * len(domains) :]
    w = np.array([max(0.0, weights.get(name, 0.0)) for name in domains]) * (now > 0)
    target = (float(now.sum()) if budget is None else budget) * (w if w.sum() else now) / max((w if w.sum() else now).sum(), 1e-12)
    found = 1.0
    for u, most in zip(np.array(directions, float), far):
        steep = most * held.sum() - u @ held
        if steep > 1e-9:
            found = min(found, (most * target.sum() - u @ target) / steep)
    return max(0.0, found)


def mix(docs: DataFrame, model: Classifier, weights: dict[str, float], budget: float | None = None, least: Column | None = None, loosen: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens, p, rate, copies, met, bound, reached`` for each document. ``least``: the least rate of a document,
    by its ``p``; the others make up for it. ``loosen``: where the targets can't be met so, the bound is multiplied by a factor
    with which they can, nine tenths of the largest that ``largest_bound`` leaves open, or else given up. ``bound``: the factor
    taken; ``met`` says of the whole mix whether its expected shares are the targets, and ``reached`` has these shares in the
    order of ``model.domains``."""
    parts = written(posteriors(docs, model, id_col, text_col), "mixing-posteriors")
    scales = [1.0]
    if loosen and least is not None:
        most = largest_bound(parts, model.domains, weights, budget, least)
        scales = [*([1.0] if most >= 1.0 else []), 0.9 * most, 0.0]
    for scale in scales:
        fitted = fit(parts, model.domains, weights, budget, None if least is None else least * scale)
        if fitted.met:
            break
    total = max(float(fitted.reached.sum()), 1e-9)
    known = {"met": F.lit(fitted.met), "bound": F.lit(float(scale)), "reached": F.array(*[F.lit(float(t) / total) for t in fitted.reached])}
    rated = parts.withColumn("rate", fitted.rate())
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumns(known)


def shares(mixed: DataFrame, domains: list[str]) -> dict[str, float]:
    """The domains' shares of the mix's tokens, counted over the copies."""
    weight = F.col("tokens") * F.col("copies")
    row = mixed.agg(*[(F.sum(weight * F.col("p")[d]) / F.sum(weight)).alias(str(d)) for d in range(len(domains))]).first()
    return {name: row[str(d)] or 0.0 for d, name in enumerate(domains)}
