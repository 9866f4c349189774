"""Hilbert functions of edge rings by distributed distinct."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.functions import vectors
from graphmill.functions.graph6 import g6_edges
from graphmill.functions.vectors import BITS
from graphmill.operators.corpus import with_form
from graphmill.scratch import written


def _unit(vertex: str) -> Column:
    """One at a vertex (from 0). More vertices than a long has room for are an error."""
    v = F.col(vertex).cast("int")
    return F.when(v < 63 // BITS, F.call_function("shiftleft", F.lit(1).cast("long"), v * BITS)).otherwise(F.raise_error(F.lit(f"more than {63 // BITS} vertices")).cast("long"))


def _steps(edges: DataFrame, max_d: int | Column, key: str) -> DataFrame:
    """``key, n, steps, last``: vertices, packed steps of the edges and last degree of each graph."""
    last = max_d if isinstance(max_d, Column) else F.lit(max_d)
    last = F.when(last < 1 << BITS, last).otherwise(F.raise_error(F.lit("degrees would not fit")).cast("int"))
    most = F.greatest(F.max("i"), F.max("j")) + 1
    return edges.groupBy(key).agg(most.cast("int").alias("n"), F.collect_set(_unit("i") + _unit("j")).alias("steps"), F.max(last).cast("int").alias("last"))


def hilbert_function(edges: DataFrame, max_d: int | Column, key: str = "graph_number", slices: int | None = None) -> DataFrame:
    """``key, d, size``: different vertex-degree vectors of multisets of d edges, up to ``max_d`` (a number or a column of
    ``edges``). Vectors are packed in a long, five bits for each vertex (n <= 12, d <= 31), and dealt by (graph, slice of the
    vector's hash), so that a graph with hundreds of millions of them lies in no task; its steps (66 at most) are there in
    every slice. A round needs only the vectors of the one before, which are written and counted from there."""
    return _by_slices(_steps(edges, max_d, key), key, slices)


def _by_slices(steps: DataFrame, key: str, slices: int | None = None) -> DataFrame:
    spark = steps.sparkSession
    slices = slices or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = written(steps, "hilbert-steps")
    spread = steps.select(key, "steps", "last", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    front = steps.select(key, F.lit(0).cast("long").alias("vec"))
    out = steps.select(key, F.lit(0).alias("d"), F.lit(1).cast("long").alias("size"))
    for d in range(1, (steps.agg(F.max("last")).first()[0] or 0) + 1):
        dealt = front.withColumn("slice", F.pmod(F.xxhash64("vec"), F.lit(slices)).cast("int"))
        grown = dealt.join(spread.filter(F.col("last") >= d), [key, "slice"])
        front = written(grown.select(key, F.explode(F.transform("steps", lambda s: F.col("vec") + s)).alias("vec")).distinct(), "hilbert-front")
        out = out.unionByName(front.groupBy(key).agg(F.count(F.lit(1)).alias("size")).select(key, F.lit(d).alias("d"), "size"))
    return out


#: A graph whose last degree can have more vectors than this is dealt over tasks.
IN_TASK = 4_000_000
#: Graphs of a task, at most about so many.
GRAPHS = 2048


def hilbert_sizes(edges: DataFrame, max_d: int | Column, key: str = "graph_number", in_task: int = IN_TASK) -> DataFrame:
    """``key, d, size`` by either way, which agree: graphs with at most ``in_task`` vectors in a degree (there are at most
    C(2 d + n - 1, n - 1)) are counted within a task, and larger ones dealt over tasks."""
    return _rows(_sizes(_steps(edges.withColumn(key, F.col(key).cast("long")), max_d, key), key, in_task), key)


def hilbert_by_graph(edges: DataFrame, max_d: int | Column, key: str = "graph_number") -> DataFrame:
    """The same, all graphs within tasks: for whole numerators of small graphs, where the last degrees have most
    of the vectors. ``max_d`` may differ from graph to graph (a column of ``edges``)."""
    return _rows(_in_tasks(_steps(edges.withColumn(key, F.col(key).cast("long")), max_d, key), key), key)


def hilbert_of_graphs(graphs: DataFrame, max_d: int | Column, g6_col: str = "graph6", in_task: int = IN_TASK) -> DataFrame:
    """The rows of ``graphs`` (graph6 texts of up to 12 vertices) with ``sizes``, the Hilbert function from 0 to ``max_d`` (a
    number or a column). It does not depend on how vertices are numbered, so each form of a graph (``corpus.with_form``) is
    counted once, however many graphs have it."""
    rows = written(with_form(graphs, g6_col).withColumn("last", max_d if isinstance(max_d, Column) else F.lit(max_d)), "hilbert-forms")
    ends = F.explode(F.when(F.col("form").isNotNull(), g6_edges(F.col("form"))).otherwise(F.raise_error(F.lit(f"more than {63 // BITS} vertices, or no graph")).cast("array<struct<i:int,j:int>>")))
    edges = rows.select("form", "last").distinct().select("form", "last", ends.alias("e")).select("form", (F.col("e.i") - 1).alias("i"), (F.col("e.j") - 1).alias("j"), "last", F.struct("form", "last").alias("key"))
    found = _sizes(_steps(edges, F.col("last"), "key"), "key", in_task)
    return rows.join(found.select("key.*", "sizes"), ["form", "last"]).drop("form", "last")


def _rows(sizes: DataFrame, key: str) -> DataFrame:
    return sizes.select(key, F.posexplode("sizes").alias("d", "size"))


def _sizes(steps: DataFrame, key: str, in_task: int) -> DataFrame:
    """``key, sizes`` of what ``_steps`` gave."""
    steps = written(steps, "hilbert-graphs")
    log = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), F.lit(0.0), lambda t, k: t + F.log((2 * F.col("last") + k).cast("double")) - F.log(k.cast("double")))
    small = (F.col("n") < 2) | (log <= F.log(F.lit(float(in_task))))
    # the rows are small and the work is not: without a count they would be put together in a few tasks
    tasks = max(steps.sparkSession.sparkContext.defaultParallelism, -(-steps.count() // GRAPHS))
    found = _in_tasks(steps.filter(small).repartition(tasks), key)
    large = steps.filter(~small)
    if large.isEmpty():
        return found
    dealt = _by_slices(large, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "size"))), lambda x: x["size"]).alias("sizes"))
    return found.unionByName(dealt)


def _in_tasks(steps: DataFrame, key: str) -> DataFrame:
    """``key, sizes``. A task counts ``vectors.BLOCK`` graphs of as many vertices and degrees together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def counted(shape: tuple[int, int], own: list) -> pa.RecordBatch:
            found = vectors.sizes(*shape, [masks for _, masks in own])
            return pa.record_batch([pa.array([name for name, _ in own], kind), pa.array(found, pa.list_(pa.int64()))], [key, "sizes"])

        waiting: dict[tuple[int, int], list] = {}
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, n, masks, last in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = waiting.setdefault((n, last), [])
                own.append((name, masks))
                if len(own) == vectors.BLOCK:
                    yield counted((n, last), waiting.pop((n, last)))
        for shape, own in waiting.items():
            yield counted(shape, own)

    out = T.StructType([steps.schema[key], T.StructField("sizes", T.ArrayType(T.LongType()))])
    return steps.select(key, "n", "steps", "last").mapInArrow(run, out)


def numerator(sizes: Column, n: int) -> Column:
    """Coefficients of sum H(d) T^d times (1 - T)^n up to the last d."""
    signs = F.array(*[F.lit((-1) ** j * comb(n, j)).cast("long") for j in range(n + 1)])
    upto = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0).cast("long"), lambda acc, d: acc + F.get(sizes, d) * F.coalesce(F.get(signs, k - d), F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.size(sizes) - 1), upto)


def truncated(h: Column) -> Column:
    """The last two coefficients are not both zero, so that more may follow."""
    return (F.element_at(h, -1) != 0) | (F.element_at(h, -2) != 0)


def h_from_hilbert(sizes: DataFrame, n: int, key: str = "graph_number") -> DataFrame:
    """``key, h, truncated`` up to the graph's last d."""
    own = sizes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "size"))), lambda x: x["size"]).alias("s"))
    h = own.select(key, numerator(F.col("s"), n).alias("h"))
    return h.select(key, "h", truncated(F.col("h")).alias("truncated"))


def negative_h_screen(h: DataFrame) -> DataFrame:
    """A negative coefficient proves that the ring is not Cohen-Macaulay; otherwise nothing is decided. A coefficient
    of a truncated series is exact, so that its sign proves as much."""
    return h.withColumn("is_cm", F.when(F.array_min("h") < 0, 0).cast("int"))
