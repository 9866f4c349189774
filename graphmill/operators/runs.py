"""Reconciling append-only run logs, and what follows from a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import parsing

FINAL = ("done", "unconfirmed")


def is_final(status: str = "status") -> Column:
    return F.col(status).isin(*FINAL)


def best_by(df: DataFrame, key: str, *order: Column | str, least: bool = False) -> DataFrame:
    """The row of each key with the greatest (or least) order; one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    pick = (F.min_by if least else F.max_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(pick.alias("r")).select(key, "r.*")


def latest_runs(runs: DataFrame, key: str = "graph_number", line: str = "line_no") -> DataFrame:
    """The best record of each graph: a final one beats any other, then the last line holds."""
    return best_by(runs, key, is_final(), line)


def load_done(runs: DataFrame, retry: bool, key: str = "graph_number", line: str = "line_no") -> DataFrame:
    """Graphs that are not run again: with ``retry`` those whose last record is final, else all that have a record."""
    last = best_by(runs, key, line)
    return last.filter(is_final()) if retry else last


def merge_results(lines: DataFrame, key: str = "graph_number") -> DataFrame:
    """Of several files the first complete line of a graph, or its first line if none is complete."""
    return best_by(lines, key, ~F.col("complete"), "file_order", "line_no", least=True)


def coverage(wanted: DataFrame, merged: DataFrame, key: str = "graph_number") -> DataFrame:
    """One row: merged, complete, failed, missing (of the wanted)."""
    rows = wanted.select(key).distinct().join(merged.select(key, "complete"), key, "full").join(wanted.select(key, F.lit(True).alias("wanted")).distinct(), key, "left")
    return rows.agg(F.count_if(F.col("complete").isNotNull()).alias("merged"), F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("failed"), F.count_if(F.col("complete").isNull() & F.col("wanted")).alias("missing"))


def latest_by_line(lines: DataFrame, key: str = "graph_number") -> DataFrame:
    """The last line of each graph, complete or not."""
    return best_by(lines, key, "file_order", "line_no")


def latest_complete(lines: DataFrame, key: str = "graph_number") -> DataFrame:
    """The last line holds, and only then is it asked whether it is complete."""
    return latest_by_line(lines, key).filter("complete")


def failed_items(runs: DataFrame, key: str = "graph_number", failed: Column | None = None, ok: Column | None = None) -> DataFrame:
    """Keys that failed at some time and never came through."""
    failed = F.col("status").isin("timeout", "error") if failed is None else failed
    ok = is_final() if ok is None else ok
    return runs.groupBy(key).agg(F.bool_or(failed).alias("failed"), F.bool_or(ok).alias("ok")).filter("failed and not ok").select(key)


def nonneg(hilbert: DataFrame, graphs: DataFrame, h: str = "h", key: str = "graph_number") -> DataFrame:
    """Complete rows whose h-vector has no negative entry, with their graph."""
    return hilbert.filter(F.array_min(h) >= 0).join(graphs, key)


def verdict(n: Column, depth_zzp: Column, decided_by: Column, depth: Column) -> Column:
    """What is proved, as ``struct<is_cm, decided_by>``; the order of the cases matters, and unknown stays null."""
    out = lambda cm, by: F.struct(cm.cast("int").alias("is_cm"), F.lit(by).alias("decided_by"))
    return (
        F.when(depth_zzp == n, out(F.lit(1), "depth_ZZp_eq_n"))
        .when(decided_by == "negative_h", out(F.lit(0), "negative_h"))
        .when(depth.isNotNull(), out(depth == n, "depth_QQ"))
        .when(depth_zzp.isNotNull(), out(F.lit(None), "screen_ZZp"))
        .otherwise(F.struct(F.lit(None).cast("int").alias("is_cm"), F.lit(None).cast("string").alias("decided_by")))
    )


def derive_results(rows: DataFrame) -> DataFrame:
    """From ``n, m, depth, hilbert_series, toric_ideal, gens_minimal`` (and ``is_cm`` if known): h-vector, symmetry,
    Gorenstein and complete-intersection flags. A malformed series, or one of another dimension than n, is an error; no
    series gives nulls."""
    h = F.when(F.col("hilbert_series").isNotNull(), parsing.h_vector(F.col("hilbert_series"), strict=True))
    dim = parsing.hilbert_dim(F.col("hilbert_series"))
    gens = parsing.ideal_generators(F.coalesce("toric_ideal", F.lit("")))
    known = F.col("is_cm") if "is_cm" in rows.columns else F.lit(None).cast("int")
    rows = rows.withColumn("is_cm", F.coalesce(known, (F.col("depth") == F.col("n")).cast("int")))
    rows = rows.withColumn("h_vector", F.when(dim.isNotNull() & (dim != F.col("n")), F.raise_error(F.lit("dimension of the series is not n")).cast("array<int>")).otherwise(h))
    rows = rows.withColumn("h_symmetric", parsing.is_symmetric(F.col("h_vector")).cast("int"))
    rows = rows.withColumn("is_gorenstein", F.when(F.col("is_cm").isNull(), None).when(F.col("is_cm") == 0, 0).otherwise(F.col("h_symmetric")))
    rows = rows.withColumn("num_gens", F.when(F.col("toric_ideal").isNotNull(), F.size(gens)))
    rows = rows.withColumn("gen_degrees", F.when(F.col("toric_ideal").isNotNull(), F.array_sort(F.transform(gens, parsing.binomial_degree))))
    few = F.col("num_gens") == F.col("m") - F.col("n")
    return rows.withColumn("is_ci", F.when(few, 1).when((F.col("gens_minimal") == 1) & F.col("num_gens").isNotNull(), 0))


def upsert(sources: list[DataFrame], key: str = "graph6", coalesced: str | None = None) -> DataFrame:
    """Later sources replace rows of earlier ones; a column ``coalesced`` keeps its last value that is not null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("load_order", F.lit(k)) for k, s in enumerate(sources)])
    rest = [c for c in rows.columns if c not in (key, "load_order", coalesced)]
    aggregates = [F.max_by(F.struct(*rest), "load_order").alias("r")] if rest else []
    if coalesced:
        aggregates.append(F.max_by(F.col(coalesced), F.when(F.col(coalesced).isNotNull(), F.col("load_order"))).alias(coalesced))
    return rows.groupBy(key).agg(*aggregates).select(key, *([coalesced] if coalesced else []), *(["r.*"] if rest else []))


def results_from_runs(runs: DataFrame) -> DataFrame:
    """A row for each graph of the log with its verdict; ``has_result`` where the best record has a series; the depth's
    CPU seconds are those over the rationals, or else of the screen."""
    best = latest_runs(runs).withColumn("v", verdict(F.col("n"), F.col("depth_zzp"), F.col("decided_by"), F.col("depth")))
    return best.withColumn("has_result", F.col("hilbert_series").isNotNull()).withColumn("seconds_depth", F.coalesce("seconds_depth_qq", "seconds_depth_zzp")).withColumn("is_cm", F.col("v.is_cm")).withColumn("decided_by", F.col("v.decided_by")).drop("v")


def load_counts(results: DataFrame) -> DataFrame:
    """Graphs with a result and a proven verdict, and the others: those without a result are undecided as well."""
    decided = F.col("has_result") & F.col("is_cm").isNotNull()
    return results.agg(F.count_if(decided).alias("decided"), F.count_if(~decided).alias("undecided"))


def results_from_blocks(blocks: DataFrame) -> DataFrame:
    """Rows ``graph_number, graph6, m, depth, hilbert_series, toric_ideal, gens_minimal`` and the three seconds from
    ``kv`` maps of ``Key: value`` records, ready for ``derive_results``. Their generators are minimal."""
    kv = F.col("kv")
    return blocks.select(
        kv["GraphNumber"].cast("long").alias("graph_number"), kv["Graph6"].alias("graph6"), kv["NumEdges"].cast("int").alias("m"), kv["Depth"].cast("int").alias("depth"), kv["ReducedHilbertSeries"].alias("hilbert_series"), kv["ToricIdeal"].alias("toric_ideal"),
        F.lit(1).alias("gens_minimal"), *[kv[f"Seconds{name}"].try_cast("double").alias(f"seconds_{name.lower()}") for name in ("Ker", "Depth", "Hilbert")],
    )


def stage_costs(blocks: DataFrame, again: DataFrame, key: str = "graph_number") -> DataFrame:
    """Each graph's ``seconds_ker, seconds_hilbert``, ``seconds_again`` (its depth's, where that was measured again: lines
    ``graph_number, depth, seconds``, the largest of several), their sum ``cost``, and ``cpu_total`` of its own stages."""
    depth = again.groupBy(key).agg(F.max("seconds").alias("seconds_again"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    rows = blocks.join(depth, key, "left").withColumn("seconds_again", none(F.col("seconds_again")))
    early = none(F.col("seconds_ker")) + none(F.col("seconds_hilbert"))
    return rows.select(key, "seconds_ker", "seconds_hilbert", "seconds_again", (early + F.col("seconds_again")).alias("cost"), (early + none(F.col("seconds_depth"))).alias("cpu_total"))


def stuck_items(batches: DataFrame, finished: DataFrame, key: str = "graph_number") -> DataFrame:
    """The first item of each batch that is not finished: the one that an interrupted batch hung on."""
    return batches.join(finished, key, "left_anti").groupBy("batch").agg(F.min_by(key, "position").alias(key))
