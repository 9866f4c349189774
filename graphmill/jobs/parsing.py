"""Queries on solver texts: strings are formatted from whole numbers of the line items and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import parsing as p
from graphmill.jobs.base import TEXTS, graphs, table
from graphmill.functions import graph6 as g6
from graphmill.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def _series(spark, sf):
    """``(1+aT+bT^2-cT^4+T)/((1-T)^d)``: a gap, a repeated power and a negative top."""
    rows = table(spark, sf, "lineitem").select(*KEY)
    a, b, c = F.col("l_partkey") % 7 + 2, F.col("l_suppkey") % 5 + 2, F.col("l_partkey") % 4 + 2
    text = F.format_string("(1+%d*T+%d*T^2 -%d*T^4+T)/((1-T)^%d)", a, b, c, F.col("l_linenumber"))
    return rows.select("*", F.when(F.col("l_partkey") % 10 == 3, "(1+T").otherwise(text).alias("s"))


OK = "l_partkey % 10 <> 3"
H = "(l_partkey % 7 + 3) || ',' || (l_suppkey % 5 + 2) || ',0,' || -(l_partkey % 4 + 2)"


def _text(c):
    return F.concat_ws(",", c.cast("array<string>"))


@query("c01_h_vector", f"SELECT {KEYS}, CASE WHEN {OK} THEN '1,' || {H} END AS h FROM lineitem")
def c01(spark, sf):
    return _series(spark, sf).select(*KEY, F.array_join(p.h_vector(F.col("s")).cast("array<string>"), ",").alias("h"))


@query("c02_hilbert_dim", f"SELECT {KEYS}, CASE WHEN {OK} THEN l_linenumber END AS dim FROM lineitem")
def c02(spark, sf):
    return _series(spark, sf).select(*KEY, p.hilbert_dim(F.col("s")).alias("dim"))


def _ideal(spark, sf):
    rows = table(spark, sf, "lineitem").select(*KEY)
    one = F.format_string("e_1^%d*e_2-e_3*e_4", F.col("l_partkey") % 5 + 2)
    two = F.format_string("-e_5*e_6^%d-e_7^3", F.col("l_suppkey") % 3 + 2)
    text = F.concat(F.lit("ideal("), one, F.when(F.col("l_linenumber") > 2, F.concat(F.lit(", "), two)).otherwise(""), F.lit(")"))
    return rows.select("*", F.when(F.col("l_suppkey") % 6 == 0, "none").otherwise(text).alias("s"))


IDEAL = "CASE WHEN l_suppkey % 6 = 0 THEN {} WHEN l_linenumber > 2 THEN {} ELSE {} END"


@query("c03_ideal_generators", f"SELECT {KEYS}, {IDEAL.format(0, 2, 1)} AS n, CASE WHEN l_suppkey % 6 <> 0 THEN 'e_1^' || (l_partkey % 5 + 2) || '*e_2-e_3*e_4' END AS first FROM lineitem")
def c03(spark, sf):
    gens = p.ideal_generators(F.col("s"))
    return _ideal(spark, sf).select(*KEY, F.size(gens).alias("n"), F.get(gens, F.lit(0)).alias("first"))


@query("c04_binomial_degree", f"SELECT {KEYS}, " + IDEAL.format("''", "(l_partkey % 5 + 3) || ',' || (l_suppkey % 3 + 3)", "(l_partkey % 5 + 3)::VARCHAR") + " AS degrees FROM lineitem")
def c04(spark, sf):
    return _ideal(spark, sf).select(*KEY, _text(F.transform(p.ideal_generators(F.col("s")), p.binomial_degree)).alias("degrees"))


@query("c05_gen_degrees", f"SELECT {KEYS}, (l_partkey % 9) || ',' || (l_suppkey % 9) AS degrees, greatest(l_partkey % 9, l_suppkey % 9)::INT AS top FROM lineitem")
def c05(spark, sf):
    found = p.gen_degrees(F.format_string("{%d, %d}", F.col("l_partkey") % 9, F.col("l_suppkey") % 9))
    return table(spark, sf, "lineitem").select(*KEY, _text(found).alias("degrees"), F.array_max(found).alias("top"))


@query(
    "c06_h_tests",
    f"""SELECT {KEYS}, -(l_partkey % 4 + 2)::INT AS top, -(l_partkey % 4 + 2)::INT AS least, TRUE AS any_negative, TRUE AS only_top, FALSE AS symmetric,
    (l_partkey % 7 + 3 = l_linenumber + 1) AS h1_fits FROM lineitem WHERE {OK}""",
)
def c06(spark, sf):
    h = p.h_vector(F.col("s"))
    rows = _series(spark, sf).select(*KEY, h.alias("h")).filter("h is not null")
    h = F.col("h")
    return rows.select(
        *KEY, F.element_at(h, -1).alias("top"), F.array_min(h).alias("least"), (F.array_min(h) < 0).alias("any_negative"), p.negative_only_at_top(h).alias("only_top"), p.is_symmetric(h).alias("symmetric"),
        ((h[0] == 1) & (h[1] == F.col("l_linenumber") + 1)).alias("h1_fits"),
    )


@query(
    "c07_masks_and_lists",
    f"""WITH {TEXTS} SELECT g AS graph_number, b % 512 AS mask, (SELECT coalesce(string_agg((v + 1)::VARCHAR, ',' ORDER BY v), '') FROM (SELECT unnest(range(9)) AS v) WHERE ((b % 512) >> v::INT) & 1 = 1) AS vertices,
    '[' || (SELECT string_agg('{{"i":' || (i + 1) || ',"j":' || (j + 1) || '}}', ',' ORDER BY j, i) FROM edges e WHERE e.g = texts.g) || ']' AS edges_json FROM texts JOIN bits USING (g)""",
)
def c07(spark, sf):
    rows = graphs(spark, sf)
    tail = lambda k: F.ascii(F.substr("graph6", F.lit(k), F.lit(1))) - 63
    mask = (tail(6) % 8 * 64 + tail(7)).cast("long")
    vertices = g6.mask_to_list(mask, F.lit(9))
    rows = rows.select("graph_number", "graph6", g6.list_to_mask(vertices).alias("mask"), F.concat_ws(",", F.transform(vertices, lambda v: v.cast("string"))).alias("vertices"))
    return rows.select("graph_number", "mask", "vertices", F.to_json(g6.g6_edges(F.col("graph6"))).alias("edges_json"))


@query(
    "c08_polynomial_text",
    f"SELECT {KEYS}, '1+' || (l_partkey % 7 + 3) || '*T+' || (l_suppkey % 5 + 2) || '*T^2-' || (l_partkey % 4 + 2) || '*T^4' AS polynomial FROM lineitem WHERE {OK}",
)
def c08(spark, sf):
    return _series(spark, sf).select(*KEY, p.h_text(p.h_vector(F.col("s"))).alias("polynomial")).filter("polynomial is not null")
