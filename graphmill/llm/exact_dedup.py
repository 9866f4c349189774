"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest: a first row for each distinct text with the id that
stays, and a row with the number of further copies for each later batch that has some. A batch of documents is reduced
to its digests, its groups are anti-joined with the index (sort-merge; the index side needs no shuffle) and what is new is
appended, together with the copies of what is known, in one write under the batch's name: a batch whose rows are there was
added before and is not added again. ``compact`` merges the rows of a digest and the files of a bucket. Rows meet the label
of their digest in a join that keeps hot digests where they are. All of it is DataFrame code that runs in the JVM.

A table that exists keeps its number of buckets, whatever the session's number of partitions. Compaction writes the new
table whole before the old one goes; where a crash left only the new one, opening the index takes it.

Defined cases: a null text counts as empty; an empty text is a text like any other; repeated rows (same id, same
text) are members of one group and share the decision of their id; rows with a null id never win against a row
with an id, and stay only if their whole group has none; an empty table gives no rows and leaves the index as it
is; columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.common import text_of, written
from graphmill.llm.skew import join_labels


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col).cast("binary"), 256).alias("text_sha256"), *(carry or []))


_COLUMNS = ["text_sha256", "keep_id", "group_size", "first", "batch"]


class DigestIndex:
    """A bucketed table ``(text_sha256, keep_id, group_size, first, batch)``; ``buckets`` counts when it is created."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name) and spark.catalog.tableExists(self._compacted):
            spark.sql(f"ALTER TABLE {self._compacted} RENAME TO {name}")
        if spark.catalog.tableExists(name):
            found = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()
            self.buckets = int(found["data_type"])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._append(spark.createDataFrame([], "text_sha256 string, keep_id long, group_size long, first boolean, batch string"), name)

    @property
    def _compacted(self) -> str:
        return f"{self.name}_compacted"

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """``text_sha256, keep_id, group_size``: a row for each distinct text, with its copies in all batches so far."""
        return self.table().groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def _append(self, rows: DataFrame, name: str) -> None:
        (
            rows.select(*_COLUMNS)
            .repartition(self.buckets, "text_sha256")
            .write.bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .mode("append")
            .saveAsTable(name)
        )

    def compact(self) -> None:
        """One row for each digest and one file for each bucket; the names of earlier batches are forgotten."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._compacted}")  # of a compaction that did not end
        self._append(self.groups().withColumns({"first": F.lit(True), "batch": F.lit(None).cast("string")}), self._compacted)
        self.drop()
        self.spark.sql(f"ALTER TABLE {self._compacted} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")

    def merge(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add the rows ``doc_id, text_sha256`` of one batch. Within it the largest id stays; a text that the index has keeps
        its old id. A batch of a name that the index has already changes nothing."""
        if batch is not None and not self.table().filter(F.col("batch") == batch).isEmpty():
            return
        groups = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = written(groups.withColumn("batch", F.lit(batch or uuid.uuid4().hex)), "groups").hint("merge")
        known = self.table().filter("first").select("text_sha256").hint("merge")
        copies = groups.join(known, "text_sha256", "left_semi").withColumns({"keep_id": F.lit(None).cast("long"), "first": F.lit(False)})
        new = groups.join(known, "text_sha256", "left_anti").withColumn("first", F.lit(True))
        self._append(copies.select(*_COLUMNS).unionByName(new.select(*_COLUMNS)), self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` within the batch and against the index, append what is new, and return a row for
        each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

        Within a batch the row with the largest id stays; a text that the index has already keeps its old id, and
        all its new copies are dropped (so batches are added newest first where the largest id of all is to stay).
        ``group_size`` counts all batches.
        """
        rows = written(digests(docs, id_col, text_col), "digests")
        self.merge(rows, batch)
        return written(self.labelled(rows), "deduplicated")  # as of now

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``doc_id, text_sha256`` and others), each with ``keep_id, group_size, kept``."""
        total = rows.count()
        labels = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_rows")).hint("merge").join(self.groups().hint("merge"), "text_sha256")
        found = join_labels(rows, labels, "text_sha256", "_rows", total).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *[c for c in rows.columns if c not in ("doc_id", "text_sha256")])


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All of ``docs`` against an index in two batches, those with the larger ids first: a row for each document as of
    ``add`` with the columns ``carry``. Texts are read once; batches are batches of digests."""
    rows = written(digests(docs, id_col, text_col, carry), "digests")
    key = F.col("doc_id").cast("long")
    middle = rows.agg(F.percentile_approx(key, 0.5)).first()[0]
    late = key > F.lit(middle) if middle is not None else F.lit(False)
    index.merge(rows.filter(late))
    index.merge(rows.filter(~F.coalesce(late, F.lit(False))))
    return index.labelled(rows)
