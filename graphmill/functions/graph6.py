"""graph6 texts as columns, by built-in functions.

Vertices are numbered from 0 inside and from 1 in edge lists. Bit ``j(j-1)/2 + i`` of a text stands for the edge
(i, j), i < j; a character holds six bits, the first one highest, plus 63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET, MOST_VERTICES = 63, 62


def g6_n(g6: Column) -> Column:
    """Number of vertices; more than 62 is an error."""
    n = F.ascii(g6) - OFFSET
    return F.when(n <= MOST_VERTICES, n).otherwise(F.raise_error(F.lit("graph6: more than 62 vertices")).cast("int"))


def _bit(g6: Column, k: Column) -> Column:
    byte = F.ascii(F.substr(g6, F.floor(k / 6).cast("int") + 2, F.lit(1))) - OFFSET
    return F.call_function("getbit", byte.cast("long"), (5 - k % 6).cast("int"))


def g6_edges(g6: Column) -> Column:
    """``array<struct<i, j>>`` counted from 1, by j and then i."""
    n = g6_n(g6)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: F.struct(i.alias("i"), j.alias("j")))))
    there = F.filter(pairs, lambda p: (p["j"] < n) & (_bit(g6, (p["j"] * (p["j"] - 1) / 2).cast("int") + p["i"]) == 1))
    return F.transform(there, lambda p: F.struct((p["i"] + 1).alias("i"), (p["j"] + 1).alias("j")))


def g6_adj(g6: Column) -> Column:
    """Neighbour masks, one for each vertex from 0, straight from the bits."""
    vertices = F.sequence(F.lit(0), g6_n(g6) - 1)
    pair = lambda v, w: _bit(g6, (F.greatest(v, w) * (F.greatest(v, w) - 1) / 2).cast("int") + F.least(v, w))
    bit = lambda v, w: F.when(v == w, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", pair(v, w).cast("long"), w))
    return F.transform(vertices, lambda v: F.aggregate(vertices, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(bit(v, w))))


def num_edges(g6: Column) -> Column:
    """Set bits of the characters; the last one is filled up with zeros."""
    return F.aggregate(F.sequence(F.lit(2), F.length(g6)), F.lit(0), lambda acc, k: acc + F.bit_count(F.ascii(F.substr(g6, k, F.lit(1))) - OFFSET))


def g6_of_bits(n: int, bits: Column) -> Column:
    """Text of a graph of n vertices from the array of its edges' bit numbers."""
    chars = -(-n * (n - 1) // 2 // 6)
    value = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0), lambda acc, p: acc * 2 + F.array_contains(bits, c * 6 + p).cast("int"))
    return F.concat(F.lit(chr(OFFSET + n)), F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(chars - 1)), lambda c: F.chr(value(c) + OFFSET))))


def g6_of_long(n: int, bits: Column) -> Column:
    """The same from a long with a bit for each edge, the first edge's highest of all characters (n <= 11)."""
    chars = -(-n * (n - 1) // 2 // 6)
    char = lambda c: F.chr(F.call_function("shiftright", bits, F.lit(6 * (chars - 1 - c))).bitwiseAND(63) + OFFSET)
    return F.concat(F.lit(chr(OFFSET + n)), *[char(c) for c in range(chars)])


def g6_encode(edges: DataFrame, n: int, key: str = "graph_number") -> DataFrame:
    """``key, graph6`` from long rows ``key, i, j`` (0 <= i < j < n); repeated edges count once. Up to 11 vertices a graph is
    a long, which rows add their bits to before the shuffle."""
    bit = (F.col("j") * (F.col("j") - 1) / 2).cast("int") + F.col("i").cast("int")
    top = 6 * -(-n * (n - 1) // 2 // 6) - 1
    if top < 63:
        found = edges.groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), top - bit)).alias("bits"))
        return found.select(key, g6_of_long(n, F.col("bits")).alias("graph6"))
    return edges.groupBy(key).agg(F.collect_set(bit).alias("bits")).select(key, g6_of_bits(n, F.col("bits")).alias("graph6"))


def triangle_count(edges: DataFrame, key: str = "graph_number") -> DataFrame:
    """``key, n_triangles`` from long rows ``key, i, j`` (i < j), by self-joins within a graph; 0 without any."""
    ab, bc, ac = edges.select(key, F.col("i").alias("a"), F.col("j").alias("b")), edges.select(key, F.col("i").alias("b"), F.col("j").alias("c")), edges.select(key, F.col("i").alias("a"), F.col("j").alias("c"))
    found = ab.join(bc, [key, "b"]).join(ac, [key, "a", "c"]).groupBy(key).agg(F.count(F.lit(1)).alias("n_triangles"))
    return edges.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n_triangles", F.lit(0)).alias("n_triangles"))


def mask_to_list(mask: Column, n: Column) -> Column:
    """Vertices from 1 of a mask."""
    return F.filter(F.sequence(F.lit(1), n), lambda v: F.call_function("getbit", mask, v - 1) == 1)


def list_to_mask(vertices: Column) -> Column:
    return F.aggregate(vertices, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v - 1)))


def edges_text(edges: Column) -> Column:
    """``{{i,j}, ...}`` as solvers take it."""
    return F.concat(F.lit("{"), F.concat_ws(", ", F.transform(edges, lambda e: F.format_string("{%d,%d}", e["i"], e["j"]))), F.lit("}"))
