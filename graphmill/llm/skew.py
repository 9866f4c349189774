"""Joins and components that stay even however large one group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import written

#: A key is hot if it holds more than this share of the rows. At most 1 / HOT_SHARE keys can be, so their labels
#: have a proven size and may be broadcast.
HOT_SHARE = 1 / 4096


def join_labels(rows: DataFrame, labels: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``labels`` of their ``key`` (rows without one are left out).

    ``size`` of a label is the number of ``rows`` with that key, ``total`` the number of all rows. Labels of hot
    keys are broadcast, so their rows stay where they are; the rest meet in a sort-merge join.
    """
    limit = F.lit(total * HOT_SHARE)
    hot = F.broadcast(labels.filter(F.col(size) > limit))
    cold = labels.filter(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").hint("merge").join(cold.hint("merge"), key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``node, root`` (the least node) for each node of an edge, by alternating large-star and
    small-star steps; each step is written to the shared folder. A node with very many neighbours, such as the root of a
    giant component, is met by a broadcast of its label. Loops and repeated edges are harmless."""
    state = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    sign, size = None, state.count()
    while True:
        # large star: the larger neighbours of a node move to the least node of its neighbourhood
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_labels(both, least, "u", "n", 2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_labels(large, least, "u", "n", large.count()).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        state = written(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        size, mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (size, mark) == sign:
            break
        sign = size, mark
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
