"""Whole Hilbert numerators of the band's graphs, and what is tabulated from them.

A graph that fails the odd cycle condition is computed to degree n. The ring of one that satisfies it is normal, so its
numerator has degree n - k at most, where k is the least degree with an interior point; interior points have positive
coordinates with sum 2 k, so that is n / 2 at most. These go one degree further, which must give 0.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import functions as F

from graphmill.jobs.base import BEST, CYCLES, N, VERDICT, band, runs, spread
from graphmill.operators import corpus, hilbert, relate as ops, runs as run_ops
from graphmill.registry import query

SIGNS = ", ".join(f"({j}, {(-1) ** j * comb(N, j)})" for j in range(N + 1))


def whole_sql(graphs_sql: str) -> str:
    """CTEs ``wsize`` and ``wh`` for the graphs of a query (``g``, and ``last``: the last degree)."""
    return (
        f"wvec AS (SELECT g, last, 0 AS d, 0::BIGINT AS v FROM ({graphs_sql}) UNION SELECT x.g, x.last, x.d + 1, x.v + (1::BIGINT << (5 * e.i)::INT) + (1::BIGINT << (5 * e.j)::INT) FROM wvec x JOIN edges e USING (g) WHERE x.d < x.last), "
        f"wsize AS (SELECT g, last, d, count(*) AS size FROM wvec GROUP BY g, last, d), wsign AS (SELECT * FROM (VALUES {SIGNS}) t(j, c)), "
        "wh1 AS (SELECT g, last, d + j AS k, sum(c * size)::BIGINT AS v FROM wsize CROSS JOIN wsign WHERE d + j <= last GROUP BY g, last, d + j), "
        "wh AS (SELECT g, string_agg(v::VARCHAR, ',' ORDER BY k) AS h, min(v) AS least, count(*) FILTER (v < 0) AS below, arg_max(v, k) FILTER (v <> 0) AS top, max(v) FILTER (k = 0) AS h0, max(v) FILTER (k = 1) AS h1, "
        f"count(*) FILTER (v <> 0 AND k >= {N - 1}) > 0 AS truncated FROM wh1 GROUP BY g)"
    )


WHOLE = f"WITH RECURSIVE {CYCLES}, {whole_sql(f'SELECT g, CASE WHEN g IN (SELECT g FROM pairs) THEN {N} ELSE {N // 2 + 1} END AS last FROM band')}"


def whole(spark, sf):
    """``graph_number, graph6, m, fails_occ, sizes`` of the band."""
    known = corpus.with_features(spread(band(spark, sf)), ["m", "fails_occ"])
    return hilbert.hilbert_of_graphs(known, F.when(F.col("fails_occ") == 1, N).otherwise(N // 2 + 1))


def numerators(spark, sf):
    """``graph_number, graph6, m, fails_occ, h, truncated``. Those that satisfy the condition have to end within what was
    computed: a last coefficient that is not 0 is an error."""
    h = whole(spark, sf).withColumn("h", hilbert.numerator(F.col("sizes"), N)).drop("sizes")
    ends = F.when(F.element_at("h", -1) == 0, False).otherwise(F.raise_error(F.lit("a normal numerator does not end at half of the vertices")).cast("boolean"))
    return h.withColumn("truncated", F.when(F.size("h") > N, hilbert.truncated(F.col("h"))).otherwise(ends))


def text(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


@query("u03_hilbert_function", f"{WHOLE} SELECT g AS graph_number, d, size FROM wsize")
def u03(spark, sf):
    return whole(spark, sf).select("graph_number", F.posexplode("sizes").alias("d", "size"))


@query("u04_negative_h_screen", f"{WHOLE} SELECT g AS graph_number, h, truncated, CASE WHEN least < 0 THEN 0 END AS is_cm FROM wh")
def u04(spark, sf):
    return hilbert.negative_h_screen(numerators(spark, sf)).select("graph_number", text("h").alias("h"), "truncated", "is_cm")


@query("g06_numerators_by_edges", f"{WHOLE} SELECT m, h, truncated, count(*) AS n FROM wh JOIN band USING (g) GROUP BY m, h, truncated")
def g06(spark, sf):
    return numerators(spark, sf).groupBy("m", text("h").alias("h"), "truncated").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g09_numerator_rules",
    f"""{WHOLE}, r AS (SELECT m, h0, h1, least, g IN (SELECT g FROM pairs) AS fails FROM wh JOIN band USING (g)) SELECT 'h0_is_one' AS rule, count(*) FILTER (h0 <> 1) AS violations FROM r
    UNION ALL SELECT 'h1_is_m_minus_n', count(*) FILTER (h1 <> m - {N}) FROM r UNION ALL SELECT 'satisfied_means_nonnegative', count(*) FILTER (NOT fails AND least < 0) FROM r""",
)
def g09(spark, sf):
    h = F.col("h")
    return ops.check_rules(numerators(spark, sf), {"h0_is_one": h[0] == 1, "h1_is_m_minus_n": h[1] == F.col("m") - N, "satisfied_means_nonnegative": (F.col("fails_occ") == 1) | (F.array_min(h) >= 0)})


#: Numbers of the graphs of the band in order, their numerators and, where the log has one, a verdict.
PROVED = f"""{WHOLE}, {BEST}, v AS (SELECT graph_number, {VERDICT} FROM best),
p AS (SELECT wh.g, row_number() OVER (ORDER BY wh.g) AS number, wh.h, least, m, wh.g IN (SELECT g FROM pairs) AS fails, is_cm, h0, h1 FROM wh JOIN band ON band.g = wh.g LEFT JOIN v ON v.graph_number = wh.g),
q AS (SELECT *, CASE WHEN is_cm = 1 THEN (regexp_replace(h, '(,0)+$', '') = array_to_string(list_reverse(string_split(regexp_replace(h, '(,0)+$', ''), ',')), ','))::INT WHEN is_cm = 0 THEN 0 END AS gorenstein FROM p)"""


def proved(spark, sf):
    """``n, number, graph_number, h`` (without the zeros at the end)``, m, fails_occ, is_cm, gorenstein``: joined on the graph's
    own number among those of n vertices."""
    best = run_ops.latest_runs(runs(spark, sf)).withColumn("v", run_ops.verdict(F.lit(N), F.col("depth_zzp"), F.col("decided_by"), F.col("depth")))
    best = best.select(F.lit(N).alias("n"), "graph_number", F.col("v.is_cm").alias("is_cm"))
    zeros = F.aggregate(F.reverse("h"), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, x: F.struct((s["k"] + (s["on"] & (x == 0)).cast("int")).alias("k"), (s["on"] & (x == 0)).alias("on")))
    short = F.slice("h", F.lit(1), F.size("h") - zeros["k"])
    own = numerators(spark, sf).select(F.lit(N).alias("n"), "graph_number", "m", "fails_occ", short.alias("h"))
    rows = corpus.numbered(own, "graph_number", "number").join(best, ["n", "graph_number"], "left")
    symmetric = (F.col("h") == F.reverse("h")).cast("int")
    return rows.withColumn("gorenstein", F.when(F.col("is_cm") == 1, symmetric).when(F.col("is_cm") == 0, 0))


@query(
    "g09_theorem_rules",
    f"""{PROVED} SELECT 'numbers_have_no_gap' AS rule, (max(number) - count(DISTINCT number))::BIGINT AS violations FROM q UNION ALL SELECT 'n_and_number_are_unique', count(*) - count(DISTINCT number) FROM q
    UNION ALL SELECT 'h0_is_one', count(*) FILTER (h0 <> 1) FROM q UNION ALL SELECT 'h1_is_m_minus_n', count(*) FILTER (h1 <> m - {N}) FROM q
    UNION ALL SELECT 'cm_means_nonnegative', count(*) FILTER (is_cm = 1 AND least < 0) FROM q UNION ALL SELECT 'occ_means_cm', count(*) FILTER (NOT fails AND is_cm = 0) FROM q""",
)
def g09_theorems(spark, sf):
    rows = proved(spark, sf)
    c, h = F.col, F.col("h")
    rules = {"h0_is_one": h[0] == 1, "h1_is_m_minus_n": F.coalesce(F.get("h", F.lit(1)), F.lit(0)) == c("m") - N, "cm_means_nonnegative": (c("is_cm") != 1) | (F.array_min("h") >= 0), "occ_means_cm": (c("fails_occ") == 1) | (c("is_cm") != 0)}
    return ops.check_rules(rows, rules).unionByName(ops.numbering_rules(rows, ["n"], "number"))


@query("g09_gorenstein_set", f"{PROVED} SELECT {N} AS n, number, fails, regexp_replace(h, '(,0)+$', '') AS h FROM q WHERE gorenstein = 1")
def g09_gorenstein(spark, sf):
    """The graphs whose ring is Cohen-Macaulay with a symmetric numerator, and whether they fail the condition."""
    return proved(spark, sf).filter("gorenstein = 1").select("n", "number", (F.col("fails_occ") == 1).alias("fails"), text("h").alias("h"))
