"""Quality scores by compression.

One Zstandard dictionary is trained on good and one on bad labelled texts. A text is cut in blocks, each block is
compressed with either dictionary, and the difference of the total sizes over their sum (bad minus good: positive for
good texts) becomes a probability by a logistic calibration on other labelled texts. Blocks are compressed one by one
because a long text soon teaches the compressor more than the dictionary does; all blocks of a text count.

Half of the chosen labelled documents give blocks for the dictionaries (each trained in a task of its own), the other half
calibrates; only the dictionaries and a number for each calibrating document come to the driver.

Defined cases: null counts as empty; an empty text has difference zero and so a score like any other; where one
class has no labelled text the score is the share of the class that has (0.5 without labels); conflicting labels of
one id count as 0; repeated rows give repeated rows; an empty table gives none; columns other than those named are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.arrays import logistic, sigmoid
from graphmill.llm.common import bounded, text_of, written

BLOCK, LEVEL, DICT_BYTES = 2048, 3, 48 * 1024
#: At most so many labelled documents of each class are learned from, chosen by a hash of the id; half build the
#: dictionaries, half calibrate.
TRAIN_DOCS = 1600
#: At most so many different labelled blocks (of all blocks of the chosen documents, by a hash of each) go into a dictionary.
DICT_BLOCKS = 8000


def blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self) -> tuple | None:
        if not self.good or not self.bad:
            return None
        make = lambda raw: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), level=LEVEL, write_content_size=False, write_dict_id=False).compress
        return make(self.good), make(self.bad)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * differences + self.intercept)


def difference(text: bytes, good, bad) -> tuple[float, int, int]:
    """The normalised size difference, and the two sizes."""
    own = blocks(text)
    a, b = sum(len(good(x)) for x in own), sum(len(bad(x)) for x in own)
    return (b - a) / (a + b) if own else 0.0, a, b


def _dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary's content themselves
        return b"".join(samples)[-DICT_BYTES:]


def dictionaries(texts: DataFrame) -> dict[int, bytes]:
    """A dictionary for each ``label`` of ``texts`` (``label, text``): blocks are cut and drawn where the texts are, and
    each dictionary is trained in one task from ``DICT_BLOCKS`` blocks at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = blocks(text.as_py())
                yield pa.record_batch([pa.array([label] * len(own), pa.int32()), pa.array(own, pa.binary())], ["label", "block"])

    def learn(group: pa.Table) -> pa.Table:
        own = sorted(zip(group["hash"].to_pylist(), group["block"].to_pylist()))
        return pa.table({"label": pa.array([group["label"][0].as_py()], pa.int32()), "dictionary": pa.array([_dictionary([b for _, b in own])], pa.binary())})

    cuts = texts.select("label", "text").mapInArrow(cut, "label int, block binary").distinct().withColumn("hash", F.xxhash64("block"))  # a block that repeats is drawn once
    drawn = None
    for label in (0, 1):
        part = cuts.filter(F.col("label") == label).orderBy("hash", "block").limit(DICT_BLOCKS)
        drawn = part if drawn is None else drawn.unionByName(part)
    return {r["label"]: bytes(r["dictionary"]) for r in drawn.groupBy("label").applyInArrow(learn, "label int, dictionary binary").collect()}


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """``labels`` has the id and the label of what may be learned from; what is chosen of it is bounded, so it is
    broadcast and the documents are read once."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    everything = sum(totals.values())
    prior = (totals.get(1, 0) + 0.5) / (everything + 1)
    flat = Model(b"", b"", 0.0, float(np.log(prior / (1 - prior))))
    if len(totals) < 2:
        return flat
    chosen = bounded(known, "label", {0: train_docs, 1: train_docs}, totals, "quality")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    texts = written(texts.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).select("label", "half", "text"), "quality-sample")
    found = dictionaries(texts.filter("half = 0"))
    if not found.get(0) or not found.get(1):
        return flat
    model = Model(found[1], found[0], 0.0, 0.0)
    seen = assess(texts.filter("half = 1").withColumnRenamed("label", "doc_id"), model).select("doc_id", "difference").toPandas()
    if seen["doc_id"].nunique() < 2:
        return flat
    seen = seen.sort_values(["doc_id", "difference"])  # the same for any partitioning
    y, x = seen["doc_id"].to_numpy(), seen["difference"].to_numpy()
    share = np.array([totals[0] / everything / (y == 0).mean(), totals[1] / everything / (y == 1).mean()])
    slope, model.intercept = map(float, logistic(x * 100, y, share[y], ridge=1e-4))
    model.slope = slope * 100
    return model


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, difference, good_bytes, bad_bytes``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        use = model.compressors()
        for batch in batches:
            rows = [difference(t.as_py(), *use) if use else (0.0, 0, 0) for t in batch.column(1)]
            d = np.array([r[0] for r in rows], np.float64)
            yield pa.record_batch(
                [batch.column(0), pa.array(model.score(d)), pa.array(d), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                ["doc_id", "score", "difference", "good_bytes", "bad_bytes"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, difference double, good_bytes long, bad_bytes long")
