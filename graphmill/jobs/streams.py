"""Streaming queries: the source is run records in files, read to the end, in several runs that go on from a checkpoint; the
final state is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.jobs.base import BEST, CYCLES, RUNS, TEXTS, graphs, runs, table
from graphmill.operators.corpus import assign_batches, numbered
from graphmill.registry import query
from graphmill.scratch import new_path
from graphmill.sources.tail import tail_lines
from graphmill.streaming import log


def _stream(spark, rows, path: str):
    """``rows`` as JSON files in a folder that a stream reads."""
    rows.write.mode("append").json(path)
    return spark.readStream.schema(rows.schema).json(path)


@query("s01_stream_latest", f"WITH {BEST} SELECT graph_number, line_no, status FROM best")
def s01(spark, sf):
    """The log in three runs, the latest lines first, so that later runs bring late records."""
    path, checkpoint, store = new_path(spark, "stream-runs"), new_path(spark, "stream-checkpoint"), log.latest_runs(spark)
    rows = runs(spark, sf)
    for late in (F.col("line_no") % 4 == 3, F.col("line_no") % 4 == 1, F.col("line_no") % 2 == 0):
        found = log.stream_latest(_stream(spark, rows.filter(late), path), store, checkpoint)
    return found.select("graph_number", "line_no", "status")


@query("s02_stream_progress", f"WITH {RUNS} SELECT status, count(*) AS n, count(*) FILTER (depth_zzp = 9) AS found, round(sum(seconds), 4) AS seconds FROM runs GROUP BY status")
def s02(spark, sf):
    """Counts by status in update mode: a batch sends the few counts that it changed."""
    stream = log.stream_progress(_stream(spark, runs(spark, sf), new_path(spark, "stream-runs")), F.col("depth_zzp") == 9)
    store = log.Upserts(spark, "status", [F.col("n")])
    log.run_to_end(stream, store.write, new_path(spark, "stream-checkpoint"), "update")
    return store.current().withColumn("seconds", F.round("seconds", 4))


#: A record is late by its number: it comes with the last quarter, whatever its time.
LATE = 7
#: The watermark is ten minutes behind the last time of the first three quarters (of the times, in whole microseconds) when
#: the last quarter comes, and ten minutes behind the last of all when it is over. A window ends an hour after it begins.
RATE = f"""e AS (SELECT event_id, ts, epoch_us(ts) AS us, date_trunc('hour', ts) AS begins FROM events),
q AS (SELECT *, CASE WHEN event_id % 100 = {LATE} THEN 3 ELSE least(3, (us - lo) * 4 // (hi - lo)) END AS quarter FROM e CROSS JOIN (SELECT min(us) AS lo, max(us) + 1 AS hi FROM e)),
mark AS (SELECT max(us) FILTER (quarter < 3) // 1000 * 1000 - 600000000 AS before, max(us) // 1000 * 1000 - 600000000 AS after FROM q),
kept AS (SELECT q.*, epoch_us(begins) + 3600000000 AS ends FROM q CROSS JOIN mark WHERE quarter < 3 OR epoch_us(begins) + 3600000000 > before),
w AS (SELECT begins, ends, count(*) AS n FROM kept GROUP BY 1, 2)"""


@query(
    "s02_stream_rate",
    f"WITH {RATE} SELECT begins, n, ends <= (SELECT after FROM mark) AS closed, (SELECT count(*) FROM q) AS seen, (SELECT count(*) FROM q) - (SELECT count(*) FROM kept) AS late FROM w",
)
def s02_rate(spark, sf):
    """Runs of each hour, in append mode: the events arrive by quarters of the time, and some of all times with the last.
    A window is closed once and leaves the state; what comes for it afterwards is dropped and counted."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), us.alias("us"))
    lo, hi = events.agg(F.min("us"), F.max("us") + 1).first()
    quarter = F.when(F.col("event_id") % 100 == LATE, 3).otherwise(F.least(F.lit(3), F.expr(f"(us - {lo}) * 4 div ({hi} - {lo})")))
    path, checkpoint, out, seen = new_path(spark, "stream-events"), new_path(spark, "stream-checkpoint"), new_path(spark, "stream-rate"), 0
    for k in range(4):
        stream = log.stream_rate(_stream(spark, events.filter(quarter == k).select("event_id", "ts"), path), "ts", "1 hour", "10 minutes")
        seen += log.run_counted(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}"), checkpoint).total("seen", "n")
    closed = spark.read.schema("begins timestamp, n long").option("recursiveFileLookup", "true").parquet(out)
    windows = closed.withColumn("closed", F.lit(True)).unionByName(log.open_windows(spark, checkpoint).withColumn("closed", F.lit(False)))
    counted = windows.agg(F.sum("n").alias("in_time")).select(F.lit(seen).cast("long").alias("seen"), (F.lit(seen) - F.col("in_time")).alias("late"))
    return windows.crossJoin(F.broadcast(counted)).withColumn("begins", F.col("begins").cast("timestamp_ntz"))


FAILING = f"WITH RECURSIVE {CYCLES}"


def _filtered(spark, sf) -> tuple[DataFrame, log.Progress]:
    """The corpus as lines in two runs, through the filter; the failing graphs, and what was counted on the way."""
    path, checkpoint, out, rows = new_path(spark, "stream-graphs"), new_path(spark, "stream-checkpoint"), new_path(spark, "failing"), graphs(spark, sf)
    counted = []
    for own in (F.col("graph_number") % 2 == 0, F.col("graph_number") % 2 == 1):
        stream = log.stream_failing(_stream(spark, rows.filter(own), path))
        counted.append(log.run_counted(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}"), checkpoint))
    found = spark.read.schema("graph_number long, graph6 string").option("recursiveFileLookup", "true").parquet(out)
    for more in counted[1:]:
        counted[0].batches |= more.batches
    return found, counted[0]


@query("s03_stream_failing", f"{FAILING} SELECT g AS graph_number, graph6 FROM band WHERE g IN (SELECT g FROM pairs)")
def s03(spark, sf):
    return _filtered(spark, sf)[0]


@query("s03_stream_counters", f"{FAILING} SELECT (SELECT count(*) FROM texts) AS seen, (SELECT count(*) FROM band) AS in_band, (SELECT count(DISTINCT g) FROM pairs) AS kept")
def s03_counters(spark, sf):
    """Lines seen, in the band and kept, counted as the stream goes by."""
    _, progress = _filtered(spark, sf)
    return spark.range(1).select(*[F.lit(progress.total(name, "n")).cast("long").alias(name) for name in ("seen", "in_band", "kept")])


#: Part files of the solvers: a run's part is its remainder by eight, and the last line of every part is torn.
PARTS = RUNS + """, parts AS (SELECT *, line_no % 8 AS part FROM runs), torn AS (SELECT part, max(line_no) AS line_no FROM parts GROUP BY part),
merged AS (SELECT graph_number, line_no, status, seconds FROM parts WHERE status <> 'timeout' AND line_no NOT IN (SELECT line_no FROM torn))"""
#: Batches of 50 graphs; every third was killed at its time limit, every third ended in an error.
BATCHES = TEXTS + """, p AS (SELECT g AS graph_number, row_number() OVER (ORDER BY g) AS position FROM texts), b AS (SELECT *, (position - 1) // 50 AS batch FROM p WHERE (position - 1) // 50 % 3 < 2)"""


@query(
    "s04_tail_parts",
    f"""WITH {BATCHES}, {PARTS}, best AS (SELECT graph_number, arg_max(status, line_no) AS status, arg_max(seconds, line_no) AS value FROM merged GROUP BY 1),
    stuck AS (SELECT arg_min(graph_number, position) AS graph_number, batch FROM b WHERE graph_number NOT IN (SELECT graph_number FROM best) GROUP BY batch)
    SELECT graph_number, status, value FROM best UNION ALL SELECT graph_number, CASE WHEN batch % 3 = 0 THEN 'TIMEOUT' ELSE 'ERROR' END, CASE WHEN batch % 3 = 0 THEN 3600.0 ELSE 1.0 END FROM stuck""",
)
def s04_parts(spark, sf):
    """Growing part files, followed in two runs: only whole lines of four fields are merged, the last wins, and the item on
    which an interrupted batch hung gets a line of its own. Lines without a status are too short and not merged."""
    folder, checkpoint, store = new_path(spark, "parts"), new_path(spark, "stream-checkpoint"), new_path(spark, "merged")
    rows = runs(spark, sf).withColumn("part", F.col("line_no") % 8)
    torn = rows.groupBy("part").agg(F.max("line_no").alias("torn"))  # eight rows
    status = F.when(F.col("status") != "timeout", F.col("status"))
    line = F.concat_ws("\t", F.col("graph_number").cast("string"), F.col("line_no").cast("string"), status, F.col("seconds").cast("string"))
    text = rows.join(F.broadcast(torn), "part").select("part", "line_no", F.when(F.col("line_no") == F.col("torn"), F.lit("9\tun")).otherwise(F.concat(line, F.lit("\n"))).alias("value"))
    for own in (F.col("part") < 4, F.col("part") >= 4):
        # a file for each part, whose last line has no end: rows end in a blank, and whole lines bring their line end
        text.filter(own).repartition("part").sortWithinPartitions("part", "line_no").select("part", "value").write.mode("append").partitionBy("part").option("lineSep", " ").text(folder)
        merged = log.merge_parts(tail_lines(spark, folder), store, checkpoint, 4)
    f = F.split(F.trim("value"), "\t")
    results = merged.select(f[0].cast("long").alias("graph_number"), f[1].cast("long").alias("line_no"), f[2].alias("status"), f[3].cast("double").alias("value"))
    best = results.groupBy("graph_number").agg(F.max_by(F.struct("status", "value"), "line_no").alias("r")).select("graph_number", "r.*")
    batches = assign_batches(numbered(graphs(spark, sf).select("graph_number"), "graph_number"), 50)
    ended = batches.select("batch").distinct().filter("batch % 3 < 2").select("batch", F.when(F.col("batch") % 3 == 0, "TIMEOUT").otherwise("ERROR").alias("status"), F.when(F.col("batch") % 3 == 0, 3600.0).otherwise(1.0).alias("value"))
    return log.with_stuck(best, batches, ended)
