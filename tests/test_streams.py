"""Streams: growing files, keyed state, late records and counters."""

import os
import random

from pyspark.sql import functions as F

from graphmill.scratch import new_path
from graphmill.sources import tail
from graphmill.streaming import log

LOG = "graph_number long, line_no long, status string"


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_lines_of_any_parts(tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(["", "a", "bc", "d" * 40]) + "\n" for _ in range(200)).encode()
    (tmp_path / "f").write_bytes(text + b"torn")
    files, root = tail._opened(str(tmp_path))
    assert tail.last_end(files, f"{root}/f", 0, len(text) + 4) == len(text)
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for part in (1, 3, 7, 64, 10_000):
        got = [x for b in range(0, len(text), part) for lines in tail.lines_between(files, f"{root}/f", b, min(len(text), b + part), 0, len(text)) for x in lines]
        assert got == want


def test_a_growing_file_is_followed(spark, tmp_path):
    folder, checkpoint, store = tmp_path / "parts", str(tmp_path / "checkpoint"), str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.out").write_text("1\t2\tx\n2\t3\ty\n3\t")
    (folder / "b.out").write_text("7\tonly two\n8\t1\tz\r\n")
    (folder / "skipped.m2").write_text("9\t9\t9\n")
    merged = lambda: sorted(r["value"] for r in log.merge_parts(log_lines(), store, checkpoint, 3).collect())
    log_lines = lambda: tail.tail_lines(spark, str(folder), r".*\.out", part_bytes=5)
    assert merged() == ["1\t2\tx", "2\t3\ty", "7\tonly two", "8\t1\tz"]
    with open(folder / "a.out", "a") as f:
        f.write("4\tw\n4\t5\t")  # the torn line is whole now, and another one torn
    (folder / "c.out").write_text("5\t5\tv\n")
    assert merged() == ["1\t2\tx", "2\t3\ty", "3\t4\tw", "5\t5\tv", "7\tonly two", "8\t1\tz"]
    before = set(os.listdir(store))
    assert len(merged()) == 6  # nothing new: nothing is written but empty batches
    assert all(size_of(os.path.join(store, d)) < 2000 for d in set(os.listdir(store)) - before)
    # a batch that is replayed after a crash gives the same rows: its commit is taken back
    last = max(int(n) for n in os.listdir(os.path.join(checkpoint, "commits")) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(path := os.path.join(checkpoint, "commits", name)):
            os.remove(path)
    assert len(merged()) == 6


def test_stuck_items_get_a_line(spark):
    results = spark.createDataFrame([(1, "done", 0.5), (2, "done", 0.25)], "graph_number long, status string, value double")
    batches = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 4), (1, 4, 2), (1, 5, 6), (2, 6, 7)], "batch long, position long, graph_number long")
    ended = spark.createDataFrame([(0, "TIMEOUT", 3600.0), (1, "ERROR", 1.0)], "batch long, status string, value double")
    out = sorted(tuple(r) for r in log.with_stuck(results, batches, ended).collect())
    assert out == [(1, "done", 0.5), (2, "done", 0.25), (3, "TIMEOUT", 3600.0), (6, "ERROR", 1.0)]


def test_upserts_write_what_changed_and_go_on(spark, tmp_path):
    path, checkpoint, store = str(tmp_path / "log"), str(tmp_path / "checkpoint"), log.latest_runs(spark, str(tmp_path / "store"))

    def more(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(path)
        found = log.stream_latest(spark.readStream.schema(LOG).json(path), store, checkpoint)
        return {r["graph_number"]: (r["line_no"], r["status"]) for r in found.collect()}

    many = [(k, k, "timeout") for k in range(20_000)]
    assert len(more(many)) == 20_000
    base = size_of(store.store)
    found = more([(5, 30_000, "done"), (6, 30_001, "error")])
    assert found[5] == (30_000, "done") and found[6] == (30_001, "error") and found[7] == (7, "timeout")
    assert size_of(store.store) - base < base / 20  # follows the batch, not the state
    # a late record of lower rank changes nothing, a final one of an earlier line does
    found = more([(5, 40_000, "timeout"), (6, 3, "unconfirmed")])
    assert found[5] == (30_000, "done") and found[6] == (3, "unconfirmed")
    store.compact()
    assert {r["graph_number"]: (r["line_no"], r["status"]) for r in store.current().collect()} == found and len(store._paths()) == 1
    assert more([(8, 50_000, "done")])[8] == (50_000, "done") and len(store._paths()) == 2


def test_late_records_are_dropped_and_counted(spark, tmp_path):
    path, checkpoint, out = str(tmp_path / "events"), str(tmp_path / "checkpoint"), str(tmp_path / "out")

    def more(times):
        rows = spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").json(path)
        stream = log.stream_rate(spark.readStream.schema("ts timestamp").json(path), "ts", "1 hour", "10 minutes")
        return log.run_counted(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}"), checkpoint).total("seen", "n")

    hour = 3600
    seen = more([10, 20, hour + 5]) + more([3 * hour]) + more([30, hour + 6, 3 * hour + 1])
    closed = sorted((r["begins"].timestamp(), r["n"]) for r in spark.read.schema("begins timestamp, n long").option("recursiveFileLookup", "true").parquet(out).collect())
    still = sorted((r["begins"].timestamp(), r["n"]) for r in log.open_windows(spark, checkpoint).collect())
    assert [(t % (4 * hour), n) for t, n in closed] == [(0, 2), (hour, 1)] and [(t % (4 * hour), n) for t, n in still] == [(3 * hour, 2)]
    assert seen == 7 and seen - sum(n for _, n in closed + still) == 2  # two came too late


def test_counters_of_a_stateless_stream(spark):
    lines = [(k, g) for k, g in enumerate(["GCOe`W", "G??F~{", "F?B~w", "FCQrO", "FCQrO"])]
    path, checkpoint, kept = new_path(spark, "lines"), new_path(spark, "checkpoint"), []
    schema = "graph_number long, graph6 string"
    total = [0, 0, 0]
    for part in (lines[:2], lines[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)
        stream = log.stream_failing(spark.readStream.schema(schema).json(path))
        progress = log.run_counted(stream, lambda batch, _: kept.extend(r["graph_number"] for r in batch.collect()), checkpoint)
        total = [a + progress.total(name, "n") for a, name in zip(total, ("seen", "in_band", "kept"))]
    assert total[0] == 5 and total[2] == len(kept) and total[0] >= total[1] >= total[2] and sorted(kept) == [0, 3, 4]
