"""The run log and the corpus as streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from graphmill.operators.corpus import band_filter, failing_of_band
from graphmill.operators.runs import best_by, is_final
from graphmill.scratch import new_path

#: State in RocksDB on the executors' disks, of which a batch sends only its changes to the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings while a stream is started, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, each, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; the checkpoint lets a later call go on from here. Returns the ended query."""
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with settings(stream.sparkSession, STATE):
        query = writer.start()
    query.awaitTermination()
    return query


class Upserts:
    """A table of one row for each key that a stream updates. Every batch writes the rows that it changed to a folder of its
    own, and writes the same folder again if it is replayed; ``current`` lets the row of the greatest ``order`` hold, so what
    a batch writes follows the batch and not the table. ``compact`` merges the folders into a base, between batches."""

    def __init__(self, spark: SparkSession, key: str, order: list[Column], store: str | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.store = store or new_path(spark, "upserts")

    def _numbers(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.store}/{kind}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        whole = [s.getPath() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.store}/changes/{number}")

    def _paths(self) -> list[str]:
        base = self._numbers("base")[-1:]
        return [f"{self.store}/base/{n}" for n in base] + [f"{self.store}/changes/{n}" for n in self._numbers("changes") if not base or n > base[0]]

    def current(self) -> DataFrame | None:
        paths = self._paths()
        return best_by(self.spark.read.parquet(*paths), self.key, *self.order) if paths else None

    def compact(self) -> None:
        """One base of all folders so far; only folders of later batches are read beside it."""
        numbers = self._numbers("changes")
        if numbers and self._numbers("base")[-1:] != numbers[-1:]:
            self.current().write.mode("overwrite").parquet(f"{self.store}/base/{numbers[-1]}")


def latest_runs(spark: SparkSession, store: str | None = None, key: str = "graph_number") -> Upserts:
    return Upserts(spark, key, [is_final(), F.col("line_no")], store)


def stream_latest(runs: DataFrame, store: Upserts, checkpoint: str) -> DataFrame | None:
    """Keep the best record of each key as state and upsert the keys that a batch has touched. A late record of lower rank
    changes nothing, whenever it arrives."""
    rest = [c for c in runs.columns if c != store.key]
    best = runs.groupBy(store.key).agg(F.max_by(F.struct(*rest), F.struct(*store.order)).alias("r")).select(store.key, "r.*")
    run_to_end(best, store.write, checkpoint, "update")
    return store.current()


class Progress(StreamingQueryListener):
    """Adds up the observed metrics of a query's batches as their progress is reported; a batch counts once."""

    def __init__(self):
        self.batches: dict[int, dict[str, dict]] = {}
        self.dropped: dict[int, int] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches[p.batchId] = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.dropped[p.batchId] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def total(self, metric: str, column: str) -> int:
        return sum(m[metric][column] or 0 for m in self.batches.values() if metric in m)


def run_counted(stream: DataFrame, each, checkpoint: str, mode: str = "append") -> Progress:
    """``run_to_end`` with what the batches' progress says."""
    streams, seen = stream.sparkSession.streams, Progress()
    streams.addListener(seen)
    try:
        query = run_to_end(stream, each, checkpoint, mode)
        last = query.lastProgress
        stream.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # reports arrive after the query ended
        assert last is None or last.batchId in seen.batches
    finally:
        streams.removeListener(seen)
    return seen


def stream_progress(runs: DataFrame, found: Column) -> DataFrame:
    """Counts by status, and how many met ``found``: a streaming aggregation for update or complete mode."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(found).alias("found"), F.sum("seconds").alias("seconds"))


def stream_rate(runs: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Finished runs by tumbling window. In append mode a window is given out once, when the watermark has passed its end, and
    then leaves the state; a record of such a window comes too late and is dropped."""
    seen = runs.observe("seen", F.count(F.lit(1)).alias("n"))
    return seen.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begins"), "n")


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``begins, n`` of the windows that are still in the state of a ``stream_rate``."""
    with settings(spark, STATE):
        return spark.read.format("statestore").load(checkpoint).select(F.col("key.window.start").alias("begins"), F.col("value.count").alias("n"))


def stream_failing(lines: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """Lines in, failing graphs out; stateless. The metrics ``seen``, ``in_band`` and ``kept`` (column ``n``) count the
    lines as they go by."""
    one = F.count(F.lit(1)).alias("n")
    band = band_filter(lines.observe("seen", one), g6_col).observe("in_band", one)
    return failing_of_band(band, g6_col).observe("kept", one)


def merge_parts(parts: DataFrame, store: str, checkpoint: str, min_fields: int) -> DataFrame:
    """Append the whole lines of growing part files (``file, byte, value``) that have ``min_fields`` fields; a batch that is
    replayed writes its folder again. Returns all that was merged so far: ``file, byte, value``."""
    whole = parts.filter(F.size(F.split(F.trim("value"), r"\s+")) >= min_fields)
    run_to_end(whole, lambda batch, number: batch.write.mode("overwrite").parquet(f"{store}/{number}"), checkpoint)
    return parts.sparkSession.read.schema(parts.schema).option("recursiveFileLookup", "true").parquet(store)


def with_stuck(results: DataFrame, batches: DataFrame, ended: DataFrame, key: str = "graph_number") -> DataFrame:
    """``results`` (``graph_number, status, value``) and a row for the item on which each interrupted batch hung: the first of
    the batch, by ``position``, that has no line. ``batches``: ``batch, position, graph_number``; ``ended``: ``batch, status
    ('TIMEOUT' or 'ERROR'), value``. Items of either kind have a line now and are not run again."""
    done = results.select(key).distinct()
    stuck = batches.join(done, key, "left_anti").join(ended, "batch").groupBy("batch").agg(F.min_by(F.struct(key, "status", "value"), "position").alias("s"))
    return reduce(DataFrame.unionByName, [results.select(key, "status", "value"), stuck.select(f"s.{key}", "s.status", "s.value")])
