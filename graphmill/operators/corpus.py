"""The corpus of graphs: features, filters, numbering, shares and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from graphmill.functions import kernel
from graphmill.functions.graph6 import MOST_VERTICES, g6_adj, g6_edges, g6_n, mask_to_list
from graphmill.scratch import written

#: Subsets times graphs that the kernel holds at a time.
CELLS = 1 << 17


def _kind(column: str) -> T.DataType:
    return T.ArrayType(T.DoubleType()) if column in kernel.LISTS else T.DoubleType() if column in kernel.DOUBLES else T.LongType()


def _arrow(column: str) -> pa.DataType:
    return pa.list_(pa.float64()) if column in kernel.LISTS else pa.float64() if column in kernel.DOUBLES else pa.int64()


def with_features(graphs: DataFrame, columns: list[str], g6_col: str = "graph6") -> DataFrame:
    """The rows of ``graphs`` with feature columns behind. Only what is selected is computed. Texts that are null, have
    fewer than two or more than ``kernel.MOST_VERTICES`` vertices get nulls."""
    at = graphs.columns.index(g6_col)
    taken = [c for c in columns if c not in graphs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cells: dict[str, list] = {c: [None] * len(texts) for c in taken}
            by_n: dict[int, list[int]] = {}
            for k, t in enumerate(texts):
                if t and 2 <= ord(t[0]) - 63 <= kernel.MOST_VERTICES:
                    by_n.setdefault(ord(t[0]) - 63, []).append(k)
            for n, rows in by_n.items():
                for k in range(0, len(rows), max(1, CELLS >> n)):
                    part = rows[k : k + max(1, CELLS >> n)]
                    found = kernel.compute(kernel.decode([texts[r] for r in part]), taken)
                    for c, values in found.items():
                        values = [v.tolist() for v in values] if c in kernel.LISTS else np.asarray(values).tolist()
                        for r, v in zip(part, values):
                            cells[c][r] = None if isinstance(v, float) and v != v else v if c in kernel.DOUBLES or c in kernel.LISTS else int(v)
            yield pa.record_batch([*batch.columns, *[pa.array(cells[c], _arrow(c)) for c in taken]], [*batch.schema.names, *taken])

    return graphs.mapInArrow(run, T.StructType([*graphs.schema.fields, *[T.StructField(c, _kind(c)) for c in taken]]))


def with_form(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """With ``form``: the graph6 text after the vertices are put in an order that does not depend on their numbers (nearly
    always: ties that refining leaves go by number). Equal forms are the same graph but for its numbers; nulls as above."""
    at = graphs.columns.index(g6_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            forms: list[str | None] = [None] * len(texts)
            by_n: dict[int, list[int]] = {}
            for k, t in enumerate(texts):
                if t and 2 <= ord(t[0]) - 63 <= kernel.MOST_VERTICES:
                    by_n.setdefault(ord(t[0]) - 63, []).append(k)
            for rows in by_n.values():
                for r, form in zip(rows, kernel.forms(kernel.decode([texts[r] for r in rows]))):
                    forms[r] = form
            yield pa.record_batch([*batch.columns, pa.array(forms, pa.string())], [*batch.schema.names, "form"])

    return graphs.mapInArrow(run, T.StructType([*graphs.schema.fields, T.StructField("form", T.StringType())]))


def decoded(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """With ``n, edges, adj`` by built-in functions."""
    g6 = F.col(g6_col)
    return graphs.select("*", g6_n(g6).alias("n"), g6_edges(g6).alias("edges"), g6_adj(g6).alias("adj"))


def band_filter(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """Connected, not bipartite, least degree two or more, n + 1 <= m <= C(n, 2) - 9, for all sizes that the format has
    (up to 62 vertices; more are an error). Degrees are counted first, and only what they leave is walked through."""
    at = graphs.columns.index(g6_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.zeros(len(texts), bool)
            by_n: dict[int, list[int]] = {}
            for k, t in enumerate(texts):
                if t and ord(t[0]) - 63 > MOST_VERTICES:
                    raise ValueError(f"graph6: more than {MOST_VERTICES} vertices")
                if t and ord(t[0]) - 63 >= 2:
                    by_n.setdefault(ord(t[0]) - 63, []).append(k)
            for n, rows in by_n.items():
                adj, rows = kernel.decode([texts[r] for r in rows]), np.array(rows)
                degrees = np.bitwise_count(adj)
                m = degrees.sum(axis=1, dtype=np.int64) // 2
                cheap = (m >= n + 1) & (m <= n * (n - 1) // 2 - 9) & (degrees.min(axis=1) >= 2)
                adj, rows = adj[cheap], rows[cheap]
                even, odd = kernel.walks(adj)
                keep[rows] = (even | odd == (1 << n) - 1) & (even & odd != 0)
            yield batch.filter(pa.array(keep))

    return graphs.mapInArrow(run, graphs.schema)


def with_occ(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """With ``fails_occ`` and the witness masks ``occ_s, occ_t`` (null where the condition holds)."""
    return with_features(graphs, ["fails_occ", "occ_s", "occ_t"], g6_col)


def failing_of_band(band: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """The graphs of the band that fail the odd cycle condition. One that is too large for the kernel is an error, not left
    out."""
    fails = F.coalesce("fails_occ", F.raise_error(F.concat(F.lit(f"more than {kernel.MOST_VERTICES} vertices: "), F.col(g6_col))).cast("long"))
    return with_features(band, ["fails_occ"], g6_col).filter(fails == 1).select(*band.columns)


def failing_filter(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """Band filter, then the graphs that fail the odd cycle condition. Stateless: works on streams as well."""
    return failing_of_band(band_filter(graphs, g6_col), g6_col)


def numbered(df: DataFrame, order_col: str, name: str = "position", ranges: int | None = None) -> DataFrame:
    """With the position (from 1) by a whole-number column without repeats, however sparse.

    The rows are evaluated once, into a table. That table is dealt in ``ranges`` ranges of the order (as many as shuffle
    partitions by default) and written again, sorted, with each row's range and place in it; the ranges' sizes, summed up,
    are the offsets of the places. No window runs over the rows, and the driver sees none of them."""
    rows = written(df, "numbered-rows")
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), F.col(order_col)).sortWithinPartitions(order_col)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts a task's rows as they come
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_place": inside}), "numbered-ranges")
    before = F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("rows")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def number_graphs(lines: DataFrame, order_col: str = "line_no", g6_col: str = "graph6") -> DataFrame:
    """Band filter, then numbers in input order: the number is given before the odd cycle condition is looked at."""
    return numbered(band_filter(lines, g6_col), order_col, "graph_number")


def keep_numbered(graphs: DataFrame, failing: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """The numbered graphs that are in ``failing``, which may repeat texts. Fails if one of them was not found."""
    wanted = failing.select(g6_col).distinct()
    kept = graphs.join(wanted, g6_col, "left_semi")
    lost = wanted.join(graphs, g6_col, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} graphs of the failing set have no number")
    return kept


def take_share(positions: DataFrame, share: str, reverse: bool = False, position: str = "position") -> DataFrame:
    """The rows whose place (the position, counted from 0) is k1, k2, ... modulo K for a share ``k1,k2/K``, in order or
    reversed. Shares that name every remainder once are a partition of the rows."""
    picks, k = share.split("/")
    out = positions.filter(((F.col(position) - 1) % int(k)).isin([int(p) for p in picks.split(",")]))
    return out.orderBy(F.desc(position) if reverse else position)


def assign_batches(positions: DataFrame, size: int, position: str = "position") -> DataFrame:
    return positions.withColumn("batch", F.floor((F.col(position) - 1) / size))


def pending(jobs: DataFrame, done: DataFrame, key: str = "graph_number", limit: int | None = None) -> DataFrame:
    rest = jobs.join(done, key, "left_anti").orderBy(key)
    return rest if limit is None else rest.limit(limit)


def fill_cache(cached: DataFrame, wanted: DataFrame, columns: list[str], g6_col: str = "graph6") -> DataFrame:
    """The features of ``wanted``: rows already cached are kept, only missing keys are computed."""
    missing = wanted.select(g6_col).distinct().join(cached, g6_col, "left_anti")
    fresh = with_features(missing, columns, g6_col)
    return cached.select(g6_col, *columns).join(wanted.select(g6_col).distinct(), g6_col, "left_semi").unionByName(fresh.select(g6_col, *columns))


def occ_lists(s: Column, t: Column, n: int) -> Column:
    return F.struct(mask_to_list(s, F.lit(n)).alias("s"), mask_to_list(t, F.lit(n)).alias("t"))
