"""Joins of cycles, pairs, features and results; tabulations and tests of conjectures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.functions import kernel
from graphmill.operators.corpus import CELLS


def odd_cycles(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """A row for each chordless odd cycle: the graph's columns, ``mask, len, closed`` (with its neighbourhood). Graphs of
    more than ``kernel.MOST_VERTICES`` vertices are an error."""
    at = graphs.columns.index(g6_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            by_n: dict[int, list[int]] = {}
            for k, t in enumerate(texts):
                if t and ord(t[0]) - 63 > kernel.MOST_VERTICES:
                    raise ValueError(f"more than {kernel.MOST_VERTICES} vertices: {t}")
                if t and ord(t[0]) - 63 >= 3:
                    by_n.setdefault(ord(t[0]) - 63, []).append(k)
            for n, rows in by_n.items():
                for k in range(0, len(rows), max(1, CELLS >> n)):
                    part = np.array(rows[k : k + max(1, CELLS >> n)])
                    lattice = kernel.Lattice(kernel.decode([texts[r] for r in part]))
                    g, mask = np.nonzero(lattice.induced & (lattice.pc % 2 == 1))
                    own = batch.take(pa.array(part[g]))
                    yield pa.record_batch([*own.columns, pa.array(mask), pa.array(lattice.pc[mask]), pa.array(mask | lattice.near[g, mask])], [*batch.schema.names, "mask", "len", "closed"])

    return graphs.mapInArrow(run, T.StructType([*graphs.schema.fields, *[T.StructField(c, T.LongType()) for c in ("mask", "len", "closed")]]))


def sep_pairs(cycles: DataFrame, key: str = "graph6") -> DataFrame:
    """Separated pairs by a join of a graph's cycles with themselves: no edge between the two, each pair once."""
    a = cycles.select(key, F.col("mask").alias("a"), F.col("len").alias("len_a"), "closed")
    b = cycles.select(key, F.col("mask").alias("b"), F.col("len").alias("len_b"))
    return a.join(b, key).filter((F.col("a") < F.col("b")) & (F.col("closed").bitwiseAND(F.col("b")) == 0)).drop("closed")


def same_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """One row: keys in all frames, and keys in some but not all. Sources agree if the second is 0."""
    marked = reduce(DataFrame.unionByName, [f.select(key).distinct().withColumn("source", F.lit(k)) for k, f in enumerate(frames)])
    found = marked.groupBy(key).agg(F.count(F.lit(1)).alias("sources"))
    return found.agg(F.count_if(F.col("sources") == len(frames)).alias("agreed"), F.count_if(F.col("sources") < len(frames)).alias("differing"))


def assert_same_keys(frames: list[DataFrame], key: str) -> None:
    if differing := same_keys(frames, key).first()["differing"]:
        raise ValueError(f"sources disagree on {differing} keys of {key}")


def set_algebra(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """One row of counts of named sets, from flags in one aggregation."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in sets.items()])


def contingency(rows: DataFrame, by: list[str], **counts: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()])


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def scorecard(rows: DataFrame, predicted: str, truth: str, id_col: str, examples: int = 30) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, and the first wrong ids; rows of unknown truth do not count."""
    known = rows.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    p, t = F.col(predicted) == 1, F.col(truth) == 1
    out = known.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    # the ids are bounded before they are gathered
    wrong = known.filter(p != t).orderBy(id_col).limit(examples).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(id_col)), lambda x: x.cast("string"))).alias("counterexamples"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    out = out.select("*", ratio(c["tp"] + c["tn"], sum(c.values(), F.lit(0))).alias("accuracy"), ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"), ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"))
    return out.crossJoin(wrong)


def test_conjecture(rows: DataFrame, hypothesis: Column, conclusion: Column, id_col: str, by: str = "n") -> DataFrame:
    """The 2x2 table of hypothesis and conclusion, by ``by`` and in total: counts, the least counterexample, and the
    verdict. Unknown hypotheses and conclusions are counted apart and prove nothing."""
    h, c = hypothesis, conclusion
    flags = rows.select(by, id_col, h.alias("h"), c.alias("c"))
    h, c = F.col("h"), F.col("c")
    out = flags.rollup(by).agg(
        F.count_if(h & c).alias("holds"), F.count_if(h & ~c).alias("fails"), F.count_if(~h & c).alias("only_conclusion"), F.count_if(~h & ~c).alias("neither"), F.count_if(h.isNull() | c.isNull()).alias("unknown"),
        F.min(F.when(h & ~c, F.col(id_col))).alias("counterexample"),
    )
    return out.withColumn("verdict", F.when(F.col("fails") > 0, "refuted").when(F.col("holds") == 0, "vacuous").otherwise("holds so far"))


test_conjecture.__test__ = False


def check_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations``: rows for which a rule is false (unknown is no violation); all rules in one pass."""
    out = rows.agg(*[F.count_if(F.coalesce(~c, F.lit(False))).alias(name) for name, c in rules.items()])
    return out.unpivot([], list(rules), "rule", "violations")


def numbering_rules(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """``rule, violations``: how many numbers from 1 to the largest are missing, and how many rows repeat a number, within
    ``group``. Rows are summed up by number first, so no task gets a group."""
    once = rows.groupBy(*group, number).agg(F.count(F.lit(1)).alias("rows"))
    found = once.groupBy(*group).agg(F.max(number).alias("most"), F.count(F.lit(1)).alias("numbers"), F.sum("rows").alias("rows"))
    out = found.agg(F.coalesce(F.sum(F.col("most") - F.col("numbers")), F.lit(0)).alias("numbers_have_no_gap"), F.coalesce(F.sum(F.col("rows") - F.col("numbers")), F.lit(0)).alias("n_and_number_are_unique"))
    return out.unpivot([], ["numbers_have_no_gap", "n_and_number_are_unique"], "rule", "violations")


def profile(rows: DataFrame, columns: list[str], fill: float = -1) -> DataFrame:
    """``column, values``: different values of each column, nulls as ``fill``; columns with one value tell nothing."""
    out = rows.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("double"), F.lit(float(fill)))).alias(c) for c in columns])
    return out.unpivot([], columns, "column", "values").filter("values > 1")


def top_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    return histogram(rows, column).orderBy(F.desc("n"), column).limit(k)


def apply_filters(rows: DataFrame, spec: dict) -> DataFrame:
    """Conjunction of what ``spec`` names: ``n`` in a list, ``m`` between, equal flags, and up to two feature ranges (more
    are an error)."""
    if len(spec.get("ranges", {})) > 2:
        raise ValueError("more than two ranges")
    if "n" in spec:
        rows = rows.filter(F.col("n").isin(*spec["n"]))
    for name, value in spec.get("equal", {}).items():
        rows = rows.filter(F.col(name) == value)
    for name, (low, high) in {**({"m": spec["m"]} if "m" in spec else {}), **spec.get("ranges", {})}.items():
        rows = rows.filter(F.col(name).between(low, high))
    return rows


def lookup(rows: DataFrame, q: str) -> DataFrame:
    """By ``n:number``, by a bare number (which may be that of several n), or by graph6."""
    if ":" in q and all(p.strip().isdigit() for p in q.split(":", 1)):
        n, number = (int(p) for p in q.split(":", 1))
        return rows.filter((F.col("n") == n) & (F.col("graph_number") == number))
    return rows.filter(F.col("graph_number") == int(q)) if q.isdigit() else rows.filter(F.col("graph6") == q)


def page(rows: DataFrame, sort_by: str, number: int, size: int = 24) -> DataFrame:
    return rows.orderBy(sort_by, "graph_number").offset(number * size).limit(size)


def status(fails: Column, decided_by: Column, is_cm: Column) -> Column:
    """What the explorer says of a graph: fixed values."""
    return (
        F.when(fails == 0, "satisfies OCC")
        .when(decided_by == "screen_ZZp", "fails OCC · screened not CM (unproven)")
        .when(is_cm.isNull(), "fails OCC · not computed yet")
        .when(is_cm == 1, "fails OCC · CM")
        .otherwise("fails OCC · not CM")
    )
