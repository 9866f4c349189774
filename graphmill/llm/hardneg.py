"""Hard negatives by k-means inverted lists.

Vectors are whole numbers (each component x becomes floor(256 x)) and a score is an inner product. Anchors are a stated part
of the rows. An anchor's positives are its best other rows of the same label; for each positive the best rows of another
label whose score lies in a window below the positive's are its hard negatives. Higher scores first, ties by smaller id.

Every row is in the inverted list of its nearest centroid (k-means on a bounded sample), and each list is stored with its
radius, the largest distance of its rows from the centroid. For an anchor a of norm |a| all scores of a list lie within
|a| * radius of a's product with the centroid (Cauchy-Schwarz). A task holds a few lists, or a part of a large one, with
radii of their own; each anchor visits the lists in order of their upper bounds, skips those that lie wholly outside the
window, and stops where the bound falls strictly below the last score that it still needs. That score starts at what the
sample already gives, which are rows like any other, so most lists are never visited. Nothing is left out: results are those
of the full comparison.

Anchors come in blocks of bounded size that are broadcast; each block makes two passes over the lists, for positives and
for negatives, and a pass sends the few best of each task to be merged. The lists are never shuffled again. Rows of one
list are split by id, so a list that holds a third of all rows is shared out.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors that are
shorter than the longest end in zeros; rows that share an anchor's id are none of its positives or negatives, and repeated
rows count each; an anchor without positives or without rows in the window gives no rows; so does an empty table; columns
other than those named are not looked at. Components of which a score could leave 63 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import written

POSITIVES, NEGATIVES = 5, 3
#: Rows in the sample at most (k-means and first bounds), lists at most, rows of a part of a list, anchors of a block.
SAMPLE, LISTS, PART, BLOCK = 16_384, 1024, 4096, 16_384
#: The window in hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Scores held at a time.
HELD = 4_000_000


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """``id, label, v`` (array of longs) of the rows that take part."""
    label = F.col("label") if label is None else label
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, F.transform(x, lambda c: F.floor(c.cast("double") * 256))).alias("v"))
    return own.filter("id is not null and label is not null and v is not null")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, zeros at the end of short ones; doubles hold the products exactly."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from rows of the sample that differ."""
    x = np.unique(x, axis=0)
    centre = x[np.random.default_rng(12).permutation(len(x))[:lists]].astype(float)
    for _ in range(rounds):
        near = nearest(x, centre)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    step = max(1, HELD // max(1, len(centre)))
    return np.concatenate([np.argmax(x[k : k + step] @ centre.T - half, axis=1) for k in range(0, max(1, len(x)), step)])


@dataclass
class Index:
    """``lists``: ``list, id, label, v`` sorted by list and id within each file. The sample is held by the driver."""

    lists: DataFrame
    centre: np.ndarray
    dims: int
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray


def build(rows: DataFrame, sample: int = SAMPLE, lists: int = LISTS, partitions: int | None = None) -> Index:
    """Index all of ``rows`` (of ``whole_vectors``). Centroids are as many as the root of the number of rows."""
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    size, dims, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    dims, most = dims or 0, most or 0.0
    if dims * most**2 >= 1 << 53:
        raise ValueError("a score of these vectors could not be held exactly")
    rate = min(1.0, 2 * sample / max(1, size))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30))).limit(sample).toArrow() if size else rows.limit(0).toArrow()
    drawn = drawn.sort_by([("id", "ascending")]).combine_chunks()
    x = _matrix(drawn["v"].combine_chunks(), dims) if len(drawn) else np.zeros((0, dims))
    centre = _centroids(x, int(min(lists, max(1, round(size**0.5))))) if len(x) else np.zeros((1, dims))
    shared = spark.sparkContext.broadcast(centre)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(_matrix(batch.column(2), dims), shared.value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(near.astype(np.int32)), *batch.columns], ["list", "id", "label", "v"])

    parts = partitions or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART)))
    named = rows.mapInArrow(placed, "list int, id long, label long, v array<long>")
    kept = named.repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id")
    return Index(written(kept, "inverted-lists"), centre, dims, drawn["id"].to_numpy(), drawn["label"].to_numpy(), x)


@dataclass
class Wanted:
    """What a block of anchors looks for: the best ``k`` rows of each query. A query is an anchor with the range of scores
    it takes; ``same``: rows of its label or of the others. ``floor``: no row below it can be among the best."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool
    k: int


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best of each row (-inf never), columns in order of id: ties go to the left."""
    rows, columns = score.shape
    fine = np.isfinite(score)
    few = fine.sum(axis=1) <= k
    if few.all() or columns <= k:
        keep = fine
    else:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        above, tie = score > kth, (score == kth) & fine
        keep = np.where(few[:, None], fine, above | tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)


def _scan(a: Anchors, want: Wanted, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of one list for ``queries``: query, id, score."""
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    step = max(1, HELD // max(1, len(ids)))
    for s in range(0, len(queries), step):
        own = queries[s : s + step]
        anchor, at = np.unique(want.anchor[own], return_inverse=True)
        score = (a.x[anchor] @ x.T)[at]
        like = a.labels[want.anchor[own], None] == labels
        fits = (like == want.same) & (a.ids[want.anchor[own], None] != ids) & (score >= np.maximum(want.low, want.floor)[own, None]) & (score <= want.high[own, None])
        q, c = _best(np.where(fits, score, -np.inf), want.k)
        out.append((own[q], ids[c], score[q, c].astype(np.int64)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _ranked(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, in order."""
    order = np.lexsort([ids, -score, query])
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < k]


def visit(a: Anchors, want: Wanted, centre: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The best rows of a task's ``lists`` (list, ids in order, labels, vectors) for each query, and how many visits of a query
    to a list that took."""
    none = np.zeros(0, np.int64)
    held, visits = (none, none, none), 0
    if not lists or not len(want.anchor):
        return held, 0
    want = Wanted(want.anchor, want.low, want.high, want.floor.copy(), want.same, want.k)
    middle = np.stack([centre[n] for n, *_ in lists])
    radius = np.array([np.sqrt(((x - centre[n]) ** 2).sum(axis=1).max()) for n, _, _, x in lists])
    product, reach = a.x @ middle.T, np.sqrt((a.x**2).sum(axis=1))[:, None] * radius
    slack = 1e-6 * (1 + np.abs(product) + reach)  # rounding of the bounds
    upper, lower = (product + reach + slack)[want.anchor], (product - reach - slack)[want.anchor]
    upper[(upper < want.low[:, None]) | (lower > want.high[:, None])] = -np.inf  # wholly outside the window
    order = np.argsort(-upper, axis=1, kind="stable")
    live = np.arange(len(want.anchor))
    for turn in range(len(lists)):
        at = order[live, turn]
        bound = upper[live, at]
        on = np.isfinite(bound) & (bound >= want.floor[live])  # stop only strictly below
        live, at = live[on], at[on]
        if not len(live):
            break
        visits += len(live)
        found = [held]
        for n in np.unique(at).tolist():
            _, ids, labels, x = lists[n]
            found.append(_scan(a, want, ids, labels, x, live[at == n]))
        held = tuple(np.concatenate(parts) for parts in zip(*found))
        best = _ranked(*held, want.k)
        held = tuple(part[best] for part in held)
        # a query that has all it needs looks for nothing below its last
        size = np.bincount(held[0], minlength=len(want.anchor))
        last = np.cumsum(size) - 1
        full = np.flatnonzero(size == want.k)
        want.floor[full] = np.maximum(want.floor[full], held[2][last[full]])
    return held, visits


def _parts(batches: Iterator[pa.RecordBatch], dims: int, part: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of a task's rows, sorted by list and id; a long list in parts."""
    for batch in batches:
        lists, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        x = _matrix(batch.column(3), dims)
        edges = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]])) if len(lists) else []
        for s, e in zip(edges[:-1], edges[1:]):
            for k in range(s, e, part):
                yield int(lists[k]), ids[k : min(e, k + part)], labels[k : min(e, k + part)], x[k : min(e, k + part)]


def _search(index: Index, a: Anchors, want: Wanted) -> DataFrame:
    """``query, id, score``: the best of all tasks for each query, ranked by ``rank``."""
    shared = index.lists.sparkSession.sparkContext.broadcast((a, want, index.centre))
    dims = index.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, want, centre = shared.value
        held: list = []
        for part in _parts(batches, dims):
            held.append(part)
            if sum(x.size for *_, x in held) >= HELD:
                yield handed(visit(a, want, centre, held)[0])
                held = []
        yield handed(visit(a, want, centre, held)[0])

    def handed(found: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in found], ["query", "id", "score"])

    found = index.lists.mapInArrow(run, "query long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= want.k)


def _sampled(index: Index, a: Anchors, want: Wanted) -> np.ndarray:
    """For each query the least score that it can still need: the k-th best of the sample, if the sample has so many."""
    floor = want.floor.copy()
    for s in range(0, len(index.ids), PART):
        part = Wanted(want.anchor, want.low, want.high, floor, want.same, want.k)
        q, _, score = _scan(a, part, index.ids[s : s + PART], index.labels[s : s + PART], index.sample[s : s + PART], np.arange(len(want.anchor)))
        if len(q):
            size = np.bincount(q, minlength=len(floor))
            least = np.full(len(floor), np.inf)
            np.minimum.at(least, q, score)
            full = size == want.k
            floor[full] = np.maximum(floor[full], least[full])
    return floor


def _blocks(index: Index, anchor: Column, block: int) -> Iterator[Anchors]:
    """Blocks of anchors; ``part`` deals them by hash, so that a block is near ``block`` in size."""
    own = index.lists.filter(anchor)
    parts = max(1, -(-own.count() // block))
    for k in range(parts):
        t = own.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(parts)) == k).toArrow().sort_by([("id", "ascending")]).combine_chunks()
        if len(t):
            yield Anchors(t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"].combine_chunks(), index.dims))


def mine(index: Index, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` (over
    ``id``) holds."""
    spark = index.lists.sparkSession
    done: DataFrame | None = None
    for a in _blocks(index, anchor, block):
        many = np.arange(len(a.ids))
        free = np.full(len(many), -np.inf)
        want = Wanted(many, free, -free, free, True, positives)
        want.floor = _sampled(index, a, want)
        near = _search(index, a, want).select("query", "id", "score").toArrow().sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        q, pid, ps = (near[c].to_numpy() for c in ("query", "id", "score"))
        # 100 * negative must lie within low and high times the positive
        want = Wanted(q, -(-low * ps // 100).astype(float), (high * ps // 100).astype(float), np.full(len(q), -np.inf), False, negatives)
        want.floor = _sampled(index, a, want)
        names = pa.table({"query": np.arange(len(q)), "anchor_id": a.ids[q], "positive_id": pid, "positive_score": ps})
        found = written(_search(index, a, want).join(F.broadcast(spark.createDataFrame(names)), "query"), "hard-negatives")
        done = found if done is None else done.unionByName(found)
    if done is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
