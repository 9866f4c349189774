"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes all that its predecessor kept, written as Parquet and read again. Null texts count as empty and empty
texts are texts like any other; texts of any length are taken whole; null labels and ids are allowed; columns other than
the id and the text pass through, whatever their names; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, exact_dedup, mixing, simhash, toxicity
from graphmill.llm.common import fold, table, written
from graphmill.llm.queries import MIX, domain


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written with a number for each row, and the name of that column: no column of the documents."""
    row = f"row_{uuid.uuid4().hex}"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def _stay(rows: DataFrame, row: str, keep: DataFrame) -> DataFrame:
    """The rows whose number is in ``keep``. Texts are neither sorted nor compared: numbers are hashed and rows stream by."""
    return rows.join(keep.select(F.col("row").alias(row)).hint("shuffle_hash"), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. Texts pass through the workers once and are not shuffled. Repeated
    rows stay or go together; labels of documents that are not there are not learned from; without labels of both
    classes no document goes unless all labels are toxic."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays (one with a null id only where all are null); of rows that repeat
    that id and the text one stays. Null and empty texts are equal."""
    rows, row = _numbered(docs)
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    try:
        kept = exact_dedup.dedup(rows, index, carry=[row]).filter("kept")
        keep = written(kept.groupBy("text_sha256").agg(F.min(row).alias("row")).select("row"), "pipeline-keep")
    finally:
        index.drop()
    return _stay(rows, row, keep)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row with the least id stays (one with a null id only where all are
    null); of rows that share that id the one with the least digest, whatever else has the id; of equal rows one."""
    rows, row = _numbered(docs)
    return _stay(rows, row, written(simhash.representatives(rows, row_col=row).select("row"), "pipeline-keep"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the domains' tokens come to the target shares, which the fit meets with
    rates near one where it can. Rows that share an id get the same number of copies; a text without words has no say in the
    shares and a rate like any other; without labels every rate is one."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domain())
    mixed = mixing.mix(docs, model, MIX)
    own, times = (f"{name}_{uuid.uuid4().hex}" for name in ("id", "copies"))  # no columns of the documents
    of_id = mixed.groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    rows = docs.join(of_id, docs["doc_id"].eqNullSafe(F.col(own)))
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)).drop(times)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text: a row for each row, repeated or not."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Learned scores and rates are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
