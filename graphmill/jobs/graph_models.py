"""Modelling queries on graph features: does a graph of the band fail the odd cycle condition? Corpora of nine and of eight
vertices come from the same line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.jobs.base import CYCLES, N, at_eight, band
from graphmill.operators import tree as ops
from graphmill.operators.corpus import with_features
from graphmill.registry import query
from graphmill.scratch import written

#: Features of the queries that SQL can follow.
FEATURES = ["deg_count_2", "deg_max", "m", "n_odd_cycles", "n_triangles"]
#: The basic set A, and set B of all numeric features but those that look at separated pairs, which give the label away.
BASIC = ["n", "m", "m_minus_n", "density", "n_components", "deg_min", "deg_max", "deg_mean", "deg_std", "deg_count_2", "deg_count_3", "deg_count_4", "deg_count_5plus", "frac_deg_2", *[f"cyc_len_{k}" for k in range(3, 9)]]
MORE = ["n_threads", "thread_max_len", "n_triangles", "avg_clustering", "transitivity", "n_odd_cycles", "n_even_cycles", "girth", "odd_girth", "even_girth", *[f"chordless_len_{k}" for k in range(3, 9)],
        "node_connectivity", "edge_connectivity", "n_cut_vertices", "n_bridges", "n_blocks", "n_nonbipartite_blocks", "diameter", "radius", "avg_shortest_path", "odd_cycle_transversal", "edge_frustration", "independence_number",
        "matching_number", "chromatic_number", "is_hamiltonian"]
SETS = {"A": BASIC, "B": BASIC + MORE}

DATA = """deg AS (SELECT a.g, bit_count(a.a)::INT AS d FROM adj a JOIN band USING (g)), dd AS (SELECT g, max(d) AS deg_max, count(*) FILTER (d = 2) AS deg_count_2 FROM deg GROUP BY g),
cc AS (SELECT g, coalesce(sum(c) FILTER (len % 2 = 1), 0) AS n_odd_cycles, coalesce(sum(c) FILTER (len = 3), 0) AS n_triangles FROM cyc GROUP BY g),
data AS (SELECT band.g, (band.g IN (SELECT g FROM pairs))::BIGINT AS y, m::DOUBLE AS m, deg_max::DOUBLE AS deg_max, deg_count_2::DOUBLE AS deg_count_2, n_odd_cycles::DOUBLE AS n_odd_cycles, n_triangles::DOUBLE AS n_triangles
  FROM band JOIN dd USING (g) LEFT JOIN cc USING (g))"""
NINE, EIGHT = f"{CYCLES}, {DATA}", f"{at_eight(CYCLES)}, {DATA}"


def _level(k: int) -> str:
    """CTEs of the splits of the nodes of level ``k`` and of the rows after them (``a0``: all rows in node 1)."""
    half = "CASE WHEN {p} + {n} > 0 THEN 2 * ({p}) * ({n}) / (({p}) + ({n})) ELSE 0 END"
    value = "CASE s.feature " + " ".join(f"WHEN '{c}' THEN a.{c}" for c in FEATURES) + " END"
    return f"""u{k} AS (SELECT node, feature, value, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM (UNPIVOT a{k} ON {', '.join(FEATURES)} INTO NAME feature VALUE value) WHERE node >= {1 << k} GROUP BY 1, 2, 3),
r{k} AS (SELECT node, feature, (value + lead(value) OVER w) / 2 AS threshold, sum(pos) OVER w AS lp, sum(neg) OVER w AS ln, sum(pos) OVER v AS p, sum(neg) OVER v AS n FROM u{k} WINDOW w AS (PARTITION BY node, feature ORDER BY value), v AS (PARTITION BY node, feature)),
b{k} AS (SELECT r{k}.node, r{k}.feature, r{k}.threshold, round({half.format(p='lp / tp', n='ln / tn')} + {half.format(p='(p - lp) / tp', n='(n - ln) / tn')}, 9) AS impurity FROM r{k} CROSS JOIN total
  WHERE threshold IS NOT NULL AND p > 0 AND n > 0 AND lp + ln >= 3 AND p + n - lp - ln >= 3),
s{k} AS (SELECT node, feature, threshold FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY impurity, feature, threshold) AS place FROM b{k}) WHERE place = 1),
a{k + 1} AS (SELECT a.* REPLACE (CASE WHEN s.node IS NULL THEN a.node WHEN {value} <= s.threshold THEN 2 * a.node ELSE 2 * a.node + 1 END AS node) FROM a{k} a LEFT JOIN s{k} s ON s.node = a.node)"""


TREE = f"a0 AS (SELECT *, 1::BIGINT AS node FROM data), total AS (SELECT greatest(sum(y), 0)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS tn FROM data), {_level(0)}, {_level(1)}, splits AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"
NODES = """nodes AS (SELECT node FROM splits UNION SELECT 2 * node FROM splits UNION SELECT 2 * node + 1 FROM splits UNION SELECT 1),
up AS (SELECT node, y FROM {at} UNION ALL SELECT node >> 1, y FROM {at} WHERE node > 1 UNION ALL SELECT node >> 2, y FROM {at} WHERE node > 3),
c AS (SELECT node, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM up GROUP BY node)"""
OUT = """SELECT n.node, floor(log2(n.node))::INTEGER AS depth, s.feature, s.threshold, s.node IS NULL AS is_leaf, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, (coalesce(pos, 0) * tn > coalesce(neg, 0) * tp)::INTEGER AS predicted
FROM nodes n LEFT JOIN splits s USING (node) LEFT JOIN c USING (node) CROSS JOIN total"""


def data(spark, sf, n: int = N, features: list[str] | None = None):
    """``graph_number, fails_occ`` and features of the band, written."""
    features = features or FEATURES
    return written(with_features(band(spark, sf, n), ["fails_occ", *features]).select("graph_number", "fails_occ", *features), "model-data")


@query("m04_graph_tree_rules", f"WITH RECURSIVE {NINE}, {TREE}, {NODES.format(at='a2')} {OUT}")
def m04_rules(spark, sf):
    own = data(spark, sf)
    return ops.node_table(ops.grow(own, FEATURES, "fails_occ", 2), own, "fails_occ")


@query(
    "m04_graph_rules_at_eight",
    f"""WITH RECURSIVE {NINE}, {TREE}, other AS (SELECT * FROM (WITH RECURSIVE {EIGHT} SELECT * FROM data)), o0 AS (SELECT *, 1::BIGINT AS node FROM other),
    {', '.join(f"o{k + 1} AS (SELECT a.* REPLACE (CASE WHEN s.node IS NULL THEN a.node WHEN CASE s.feature {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN a.{c}' for c in FEATURES)} END <= s.threshold THEN 2 * a.node ELSE 2 * a.node + 1 END AS node) FROM o{k} a LEFT JOIN s{k} s ON s.node = a.node)" for k in range(2))},
    {NODES.format(at='o2')} {OUT}""",
)
def m04_elsewhere(spark, sf):
    """The rules of nine vertices with the counts of eight; ``predicted`` weighs the classes as nine vertices have them."""
    own = data(spark, sf)
    weights = own.agg(F.sum("fails_occ"), F.sum(1 - F.col("fails_occ"))).first()
    return ops.node_table(ops.grow(own, FEATURES, "fails_occ", 2), data(spark, sf, 8), "fails_occ", tuple(float(w or 0) for w in weights))


def scored(spark, sf):
    """Stored predictions: ``experiment, graph_number, fails_occ, score``."""
    columns = list(dict.fromkeys(SETS["B"]))
    nine, eight = data(spark, sf, N, columns), data(spark, sf, 8, columns)
    inside = ops.out_of_fold(nine, SETS, "graph_number", "fails_occ", rounds=6, depth=3)
    across = ops.transferred(eight, nine, SETS, "graph_number", "fails_occ", rounds=6, depth=3)
    name = lambda what: F.concat(F.lit(what), F.col("set")).alias("experiment")
    return inside.select(name("cv 9, "), "graph_number", "fails_occ", "score").unionByName(across.select(name("8 to 9, "), "graph_number", "fails_occ", "score"))


@query("m05_graph_cross_validation")
def m05(spark, sf):
    return ops.scores_by(scored(spark, sf), "experiment", "score", "fails_occ", F.floor(F.col("score") * 100))


DRAWS = " + ".join(f"(u >= {limit})::BIGINT" for limit in ops.POISSON)
HALF = "CASE WHEN {p} + {n} > 0 THEN ({p} + {n}) * (1 - pow({p} / ({p} + {n}), 2) - pow({n} / ({p} + {n}), 2)) ELSE 0 END"
REPS = 300


@query(
    "m06_graph_root_stability",
    f"""WITH RECURSIVE {NINE}, w AS (SELECT *, {DRAWS} AS w FROM (SELECT *, ('0x' || left(md5(rep || ':' || g), 8))::BIGINT AS u FROM data CROSS JOIN (SELECT unnest(range({REPS})) AS rep))),
    u AS (SELECT rep, feature, value, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM (UNPIVOT w ON {', '.join(FEATURES)} INTO NAME feature VALUE value) WHERE w > 0 GROUP BY 1, 2, 3),
    r AS (SELECT rep, feature, (value + lead(value) OVER x) / 2 AS threshold, sum(pos) OVER x AS lp, sum(neg) OVER x AS ln, sum(pos) OVER v AS p, sum(neg) OVER v AS n FROM u WINDOW x AS (PARTITION BY rep, feature ORDER BY value), v AS (PARTITION BY rep, feature)),
    s AS (SELECT rep, feature, round({HALF.format(p='(lp / p)', n='(ln / n)')} + {HALF.format(p='(1 - lp / p)', n='(1 - ln / n)')}, 9) AS impurity FROM r WHERE threshold IS NOT NULL AND p > 0 AND n > 0)
    SELECT feature, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY impurity, feature) AS place FROM s) WHERE place = 1 GROUP BY feature""",
)
def m06(spark, sf):
    return ops.bootstrap_roots(data(spark, sf), "graph_number", FEATURES, "fails_occ", REPS)


#: A stated score: long threads and few edges speak for a graph that fails, many odd cycles against it.
SCORE = "2 * {deg_count_2} - {m} + {n_triangles} - {deg_max} / 2 - {n_odd_cycles} / 16"


@query(
    "m07_graph_permutation_importance",
    f"""WITH RECURSIVE {NINE}, d AS (SELECT g, feature, value, row_number() OVER (PARTITION BY feature ORDER BY md5(feature || ':' || g), g::VARCHAR) AS position FROM (UNPIVOT data ON {', '.join(FEATURES)} INTO NAME feature VALUE value)),
    o AS (SELECT *, row_number() OVER (ORDER BY md5(g::VARCHAR), g::VARCHAR) AS position FROM data),
    s AS (SELECT d.feature, o.y, CASE d.feature {' '.join(f"WHEN '{f}' THEN " + SCORE.format(**{c: 'd.value' if c == f else f'o.{c}' for c in FEATURES}) for f in FEATURES)} END AS score FROM o JOIN d USING (position)
      UNION ALL SELECT '', y, {SCORE.format(**{c: c for c in FEATURES})} FROM data),
    b AS (SELECT feature, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY score DESC) AS tp FROM b),
    a AS (SELECT feature, round(sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS auc FROM c GROUP BY feature)
    SELECT feature, auc, round((SELECT auc FROM a WHERE feature = '') - auc, 9) AS drop FROM a WHERE feature <> ''""",
)
def m07(spark, sf):
    def score(of):
        return 2 * of("deg_count_2") - of("m") + of("n_triangles") - of("deg_max") / 2 - of("n_odd_cycles") / 16

    return ops.permutation_importance(data(spark, sf), "graph_number", FEATURES, score, "fails_occ", F.floor("score"))
