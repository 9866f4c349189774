"""The conjectures of the research log, and the explorer's presets. Numerators are whole and computed for failing graphs
only."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.jobs.base import N
from graphmill.jobs.features import LINK
from graphmill.jobs.hilbert import whole_sql
from graphmill.jobs.relate import JOINED, joined
from graphmill.operators import hilbert, relate as ops
from graphmill.registry import query
from graphmill.scratch import written

STATED = (
    JOINED
    + LINK
    + f""", {whole_sql(f"SELECT DISTINCT g, {N} AS last FROM pairs")}, same AS (SELECT g, count(*) FILTER (linkage >= 2) AS n FROM link GROUP BY g),
stated AS (SELECT j.*, wh.top AS top_coefficient, coalesce(s.n, 0) AS sep_same_block_pairs, CASE WHEN wh.least < 0 THEN FALSE WHEN NOT wh.truncated THEN TRUE END AS h_nonneg,
  CASE WHEN wh.truncated THEN NULL ELSE wh.below = 1 AND wh.top < 0 END AS only_top_negative FROM joined j LEFT JOIN same s ON s.g = j.graph_number LEFT JOIN wh ON wh.g = j.graph_number)"""
)


def numerators(h):
    """``h`` (``h, truncated``) with ``h_nonneg`` and ``only_top_negative``: the last non-zero coefficient is negative and
    no other is. Null where a truncated series cannot tell."""
    below = F.size(F.filter("h", lambda x: x < 0))
    top = F.element_at(F.filter("h", lambda x: x != 0), -1)
    return h.withColumn("h_nonneg", F.when(below > 0, False).when(~F.col("truncated"), True)).withColumn("only_top_negative", F.when(~F.col("truncated"), (below == 1) & (top < 0))).withColumn("top_coefficient", top)


#: What the numerators tell.
TOLD = ["h_nonneg", "only_top_negative", "top_coefficient"]


def stated(spark, sf, told=True):
    """Features and verdicts, and with ``told`` what the numerators of failing graphs tell."""
    rows = written(joined(spark, sf, ["sep_same_block_pairs"]), "stated")  # one pass of the kernel serves both sides
    if not told:
        return rows
    failing = hilbert.hilbert_of_graphs(rows.filter("fails_occ = 1").select("n", "graph_number", "graph6"), N)
    h = failing.select("n", "graph_number", hilbert.numerator(F.col("sizes"), N).alias("h")).withColumn("truncated", hilbert.truncated(F.col("h")))
    return rows.join(numerators(h).select("n", "graph_number", *TOLD), ["n", "graph_number"], "left")


#: Name: hypothesis and conclusion, in SQL that DuckDB and Spark read alike. Unknown values stay unknown.
CONJECTURES = {
    "c1": ("fails_occ = 1 AND is_cm = 1", "is_gorenstein = is_ci"),
    "c2": ("fails_occ = 1 AND is_cm = 0", "only_top_negative"),
    "c2_prime": ("fails_occ = 1", "(is_cm = 1) = h_nonneg"),
    "c3": ("sep_same_block_pairs > 0", "is_cm = 0"),
    "c4": ("fails_occ = 1", "(is_cm = 1) = (even_cycle_meets_pair = 0)"),
    "c4_prime": ("fails_occ = 1 AND even_cycle_meets_pair = 1", "is_cm = 0"),
    "c5": ("fails_occ = 1 AND is_hamiltonian = 1", "is_cm = 0"),
    "c6": ("fails_occ = 1 AND h_nonneg AND even_cycle_meets_pair = 0", "is_cm = 1"),
}


def _stated(name, h, c):
    sql = f"""{STATED}, f AS (SELECT n, graph_number, {h} AS h, {c} AS c FROM stated) SELECT n, count(*) FILTER (h AND c) AS holds, count(*) FILTER (h AND NOT c) AS fails, count(*) FILTER (NOT h AND c) AS only_conclusion,
      count(*) FILTER (NOT h AND NOT c) AS neither, count(*) FILTER (h IS NULL OR c IS NULL) AS unknown, min(graph_number) FILTER (h AND NOT c) AS counterexample,
      CASE WHEN count(*) FILTER (h AND NOT c) > 0 THEN 'refuted' WHEN count(*) FILTER (h AND c) = 0 THEN 'vacuous' ELSE 'holds so far' END AS verdict FROM f GROUP BY ROLLUP (n)"""

    @query(f"g10_conjecture_{name}", sql)
    def run(spark, sf):
        return ops.test_conjecture(stated(spark, sf, any(name in h + c for name in TOLD)), F.expr(h), F.expr(c), "graph_number")


for _name, (_h, _c) in CONJECTURES.items():
    _stated(_name, _h, _c)

#: The explorer's nine presets.
PRESETS = {
    "all": "TRUE", "fails_occ": "fails_occ = 1", "gorenstein": "is_gorenstein = 1", "gorenstein_failing": "is_gorenstein = 1 AND fails_occ = 1", "c3_group": "sep_same_block_pairs > 0",
    "c3_exceptions": "fails_occ = 1 AND sep_same_block_pairs = 0 AND is_cm = 0", "c4_group": "even_cycle_meets_pair = 1", "c4_counterexamples": "fails_occ = 1 AND even_cycle_meets_pair = is_cm",
    "cut_linked_cm": "fails_occ = 1 AND sep_same_block_pairs = 0 AND is_cm = 1",
}


@query("b21_presets", f"{JOINED}{LINK}, same AS (SELECT g, count(*) FILTER (linkage >= 2) AS n FROM link GROUP BY g), s AS (SELECT j.*, coalesce(same.n, 0) AS sep_same_block_pairs FROM joined j LEFT JOIN same ON same.g = j.graph_number) " + " UNION ALL ".join(f"SELECT '{name}' AS preset, graph_number FROM s WHERE {c}" for name, c in PRESETS.items()))
def b21(spark, sf):
    hits = F.filter(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in PRESETS.items()]), lambda x: x.isNotNull())
    return joined(spark, sf, ["sep_same_block_pairs"]).select(F.explode(hits).alias("preset"), "graph_number")


@query("g03_top_coefficients", f"{STATED} SELECT top_coefficient, count(*) AS n FROM stated WHERE h_nonneg = FALSE GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def g03(spark, sf):
    """The eight most frequent top coefficients of numerators with a negative one."""
    return ops.top_counts(stated(spark, sf).filter("h_nonneg = false"), "top_coefficient", 8)


#: Histograms over the failing graphs, in SQL that DuckDB and Spark read alike.
FAILING = {
    "n_minus_depth": "coalesce(CAST(n - depth AS VARCHAR(20)), 'none')", "h_negative": "CASE WHEN h_nonneg THEN 'no' WHEN NOT h_nonneg THEN 'yes' ELSE 'unknown' END",
    "only_top_negative": "CASE WHEN only_top_negative THEN 'yes' ELSE 'no' END", "top_coefficient": "CAST(top_coefficient AS VARCHAR(20))", "m": "CAST(m AS VARCHAR(20))",
    "status": "coalesce(status, 'missing')",
}


@query("g05_failing_histograms", f"{STATED} " + " UNION ALL ".join(f"SELECT '{name}' AS what, {c} AS value, count(*) AS n FROM stated WHERE fails_occ = 1 GROUP BY 1, 2" for name, c in FAILING.items()))
def g05(spark, sf):
    rows = stated(spark, sf).filter("fails_occ = 1").select(*[F.expr(c.replace("VARCHAR(20)", "STRING")).alias(name) for name, c in FAILING.items()])
    return rows.unpivot([], list(FAILING), "what", "value").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))
