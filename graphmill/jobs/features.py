"""Feature queries on the band of the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import kernel
from graphmill.jobs.base import ADJ, BAND, CYCLES, N, band, graphs
from graphmill.operators import corpus as ops
from graphmill.operators import structure
from graphmill.registry import query


def _features(name: str, columns: list[str], sql: str | None, cycles: bool = False, rounded: dict[str, int] | None = None):
    """Register the kernel's columns for the graphs of the band, against SQL that ends a WITH of band or cycles."""

    def run(spark, sf):
        rows = ops.with_features(band(spark, sf), columns)
        return rows.select("graph_number", *[F.round(c, (rounded or {})[c]).alias(c) if c in (rounded or {}) else F.col(c) for c in columns])

    run.__name__ = name
    query(name, None if sql is None else f"WITH {'RECURSIVE ' + CYCLES if cycles else BAND} {sql}")(run)


def _native(name: str, columns: list[str], sql: str, found, cycles: bool = False, rounded: dict[str, int] | None = None, head: str | None = None):
    """The same, of ``found(spark, sf)``, by built-in functions and joins."""

    def run(spark, sf):
        return found(spark, sf).select("graph_number", *[F.round(c, (rounded or {})[c]).alias(c) if c in (rounded or {}) else F.col(c) for c in columns])

    run.__name__ = name
    query(name, f"WITH {head or ('RECURSIVE ' + CYCLES if cycles else BAND)} {sql}")(run)


def _masks(spark, sf):
    return structure.with_masks(band(spark, sf))


def _pairs(spark, sf):
    """Graphs of the band with masks, their chordless odd cycles and separated pairs."""
    rows = _masks(spark, sf)
    odd = structure.cycles(rows, "graph_number", N, True).filter("len % 2 = 1")
    return rows, odd, structure.separated(odd, "graph_number")


def _cycles(chordless: bool):
    def found(spark, sf):
        rows = _masks(spark, sf)
        return structure.cycle_counts(rows, structure.cycles(rows, "graph_number", N, chordless), "graph_number", kernel.CYCLE_LENGTHS, chordless)

    return found


def _hamiltonian(spark, sf):
    rows = _masks(spark, sf)
    return structure.hamiltonian(rows, structure.cycles(rows, "graph_number", N, False), "graph_number")


def _pair_counts(spark, sf):
    return structure.pair_counts(*_pairs(spark, sf), "graph_number")


def _meeting(spark, sf):
    rows, _, pairs = _pairs(spark, sf)
    # only graphs with a pair can have a cycle that meets one
    some = rows.join(pairs.select("graph_number").distinct(), "graph_number", "left_semi")
    return structure.meeting(rows, structure.cycles(some, "graph_number", N, False).filter("len % 2 = 0"), pairs, "graph_number")


_native("f01_size", ["n", "m", "m_minus_n", "density"], "SELECT g AS graph_number, 9 AS n, m, m - 9 AS m_minus_n, round(2 * m / 72.0::DOUBLE, 9) AS density FROM band", rounded={"density": 9}, found=lambda spark, sf: structure.sizes(_masks(spark, sf)))

_native(
    "f02_degrees",
    ["deg_min", "deg_max", "deg_mean", "deg_std", "deg_count_2", "deg_count_3", "deg_count_4", "deg_count_5plus", "frac_deg_2"],
    """, d AS (SELECT a.g, bit_count(a.a)::INT AS d FROM adj a JOIN band USING (g))
    SELECT g AS graph_number, min(d) AS deg_min, max(d) AS deg_max, round(avg(d), 9) AS deg_mean, round(stddev_pop(d), 9) AS deg_std, count(*) FILTER (d = 2) AS deg_count_2, count(*) FILTER (d = 3) AS deg_count_3,
    count(*) FILTER (d = 4) AS deg_count_4, count(*) FILTER (d >= 5) AS deg_count_5plus, round(count(*) FILTER (d = 2) / 9.0::DOUBLE, 9) AS frac_deg_2 FROM d GROUP BY g""",
    rounded={"deg_mean": 9, "deg_std": 9, "frac_deg_2": 9},
    found=lambda spark, sf: structure.degrees(_masks(spark, sf)),
)

#: Components of a vertex set s: 2^components is the number of its subsets that no edge joins to the rest of it.
_native(
    "f03_threads",
    ["n_threads", "thread_max_len"],
    """, two AS (SELECT a.g, coalesce(sum(1 << a.v::INT) FILTER (bit_count(a.a) = 2), 0)::BIGINT AS s FROM adj a JOIN band USING (g) GROUP BY a.g),
    part AS (SELECT t.g, x.s, x.pc FROM two t JOIN sub x ON x.g = t.g AND x.s & t.s = x.s AND (x.near & t.s & ~x.s) = 0),
    least AS (SELECT p.g, p.s, p.pc FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.g = p.g AND q.s <> p.s AND q.s & p.s = q.s))
    SELECT b.g AS graph_number, count(l.s) AS n_threads, coalesce(max(l.pc) + 1, 0) AS thread_max_len FROM band b LEFT JOIN least l USING (g) GROUP BY b.g""",
    found=lambda spark, sf: structure.threads(_masks(spark, sf)),
)

_native(
    "f04_triangles",
    ["n_triangles", "avg_clustering", "transitivity"],
    """, d AS (SELECT a.g, a.v, bit_count(a.a)::INT AS d FROM adj a JOIN band USING (g)),
    t AS (SELECT a.g, a.v, count(*) AS t FROM adj a JOIN edges e ON e.g = a.g AND (a.a >> e.i::INT) & 1 = 1 AND (a.a >> e.j::INT) & 1 = 1 GROUP BY a.g, a.v),
    x AS (SELECT d.g, d.v, d.d, coalesce(t.t, 0) AS t FROM d LEFT JOIN t USING (g, v))
    SELECT g AS graph_number, (sum(t) // 3)::BIGINT AS n_triangles, round(sum(CASE WHEN d >= 2 THEN 2 * t / (d * (d - 1))::DOUBLE ELSE 0 END) / 9, 9) AS avg_clustering,
    round(sum(t) / nullif(sum(d * (d - 1) / 2), 0), 9) AS transitivity FROM x GROUP BY g""",
    rounded={"avg_clustering": 9, "transitivity": 9},
    found=lambda spark, sf: structure.triangles(_masks(spark, sf)),
)

_native(
    "f05_cycles",
    [*[f"cyc_len_{k}" for k in kernel.CYCLE_LENGTHS], "n_odd_cycles", "n_even_cycles", "girth", "odd_girth", "even_girth"],
    "SELECT b.g AS graph_number, "
    + ", ".join(f"coalesce(sum(c) FILTER (len = {k}), 0)::BIGINT AS cyc_len_{k}" for k in kernel.CYCLE_LENGTHS)
    + """, coalesce(sum(c) FILTER (len % 2 = 1), 0)::BIGINT AS n_odd_cycles, coalesce(sum(c) FILTER (len % 2 = 0), 0)::BIGINT AS n_even_cycles,
    min(len) AS girth, min(len) FILTER (len % 2 = 1) AS odd_girth, min(len) FILTER (len % 2 = 0) AS even_girth FROM band b LEFT JOIN cyc USING (g) GROUP BY b.g""",
    cycles=True,
    found=_cycles(False),
)

_native(
    "f06_chordless_cycles",
    [*[f"chordless_len_{k}" for k in kernel.CYCLE_LENGTHS], "n_chordless_even_cycles"],
    "SELECT b.g AS graph_number, "
    + ", ".join(f"count(s) FILTER (len = {k}) AS chordless_len_{k}" for k in kernel.CYCLE_LENGTHS)
    + ", count(s) FILTER (len % 2 = 0) AS n_chordless_even_cycles FROM band b LEFT JOIN chordless USING (g) GROUP BY b.g",
    cycles=True,
    found=_cycles(True),
)

_features(
    "f07_connectivity",
    ["node_connectivity", "edge_connectivity"],
    """, apart AS (SELECT x.g, max(x.pc) AS pc FROM sub x WHERE EXISTS (SELECT 1 FROM sub y WHERE y.g = x.g AND y.s & x.s = y.s AND y.s <> x.s AND (y.near & x.s & ~y.s) = 0) GROUP BY x.g)
    SELECT b.g AS graph_number, coalesce(9 - a.pc, 8) AS node_connectivity, b.least_cut AS edge_connectivity FROM band b LEFT JOIN apart a USING (g)""",
)

_features(
    "f08_blocks",
    ["n_cut_vertices", "n_bridges", "n_blocks"],
    """, parts AS (SELECT x.g, x.s AS whole, (log2(1 + count(*)))::INT AS comps FROM sub x JOIN sub y ON y.g = x.g AND y.s & x.s = y.s AND (y.near & x.s & ~y.s) = 0 WHERE x.pc = 8 GROUP BY x.g, x.s),
    bridges AS (SELECT e.g, count(DISTINCT e.i * 9 + e.j) AS n FROM edges e JOIN cuts c ON c.g = e.g AND c.cut = 1 AND ((c.s >> e.i::INT) & 1) <> ((c.s >> e.j::INT) & 1) GROUP BY e.g)
    SELECT b.g AS graph_number, (SELECT count(*) FROM parts p WHERE p.g = b.g AND comps > 1) AS n_cut_vertices, coalesce(r.n, 0) AS n_bridges,
    (SELECT 1 + sum(comps - 1) FROM parts p WHERE p.g = b.g)::BIGINT AS n_blocks FROM band b LEFT JOIN bridges r USING (g)""",
)

_features(
    "f08_nonbipartite_blocks",
    ["n_nonbipartite_blocks"],
    """, apart AS MATERIALIZED (SELECT DISTINCT x.g, x.s FROM sub x JOIN sub y ON y.g = x.g AND (y.s & x.s) = y.s AND y.s <> x.s AND (y.near & x.s & ~y.s) = 0),
    notbi AS (SELECT g, s FROM apart UNION SELECT z.g, z.s FROM sub z JOIN (SELECT unnest(range(9)) AS v) v ON (z.s >> v.v::INT) & 1 = 1 JOIN apart a ON a.g = z.g AND a.s = z.s - (1 << v.v::INT)),
    blk AS (SELECT z.g, z.s FROM sub z ANTI JOIN notbi n ON n.g = z.g AND n.s = z.s WHERE z.pc >= 3),
    odds AS (SELECT DISTINCT b.g, b.s FROM blk b JOIN oddc o ON o.g = b.g AND o.s & b.s = o.s)
    SELECT b.g AS graph_number, (SELECT count(*) FROM odds o WHERE o.g = b.g AND NOT EXISTS (SELECT 1 FROM odds w WHERE w.g = o.g AND w.s <> o.s AND w.s & o.s = o.s)) AS n_nonbipartite_blocks FROM band b""",
    cycles=True,
)

_native(
    "f09_distances",
    ["diameter", "radius", "avg_shortest_path"],
    """, step AS (SELECT g, v, v AS w, 0 AS d FROM (SELECT DISTINCT g, v FROM bend) UNION SELECT s.g, s.v, e.w, s.d + 1 FROM step s JOIN bend e ON e.g = s.g AND e.v = s.w WHERE s.d < 8),
    dist AS (SELECT g, v, w, min(d) AS d FROM step GROUP BY g, v, w), ecc AS (SELECT g, v, max(d) AS e, sum(d) AS t FROM dist GROUP BY g, v)
    SELECT g AS graph_number, max(e) AS diameter, min(e) AS radius, round(sum(t) / 72.0::DOUBLE, 9) AS avg_shortest_path FROM ecc GROUP BY g""",
    cycles=True,
    rounded={"avg_shortest_path": 9},
    found=lambda spark, sf: structure.distances(_masks(spark, sf)),
)

_features("f10_spectra", ["adj_eig_max", "adj_eig_min", "adj_eig_2nd", "adj_energy", "lap_algebraic_connectivity", "lap_eig_max", "signless_lap_min", "n_spanning_trees", "adj_spectrum", "lap_spectrum"], None)
@query(
    "f10_spectral_moments",
    f"""WITH {BAND}, d AS (SELECT a.g, sum(bit_count(a.a)) AS ends, sum(bit_count(a.a) * bit_count(a.a)) AS squares FROM adj a JOIN band USING (g) GROUP BY a.g),
    t AS (SELECT a.g, count(*) AS t FROM adj a JOIN edges e ON e.g = a.g AND (a.a >> e.i::INT) & 1 = 1 AND (a.a >> e.j::INT) & 1 = 1 GROUP BY a.g)
    SELECT g AS graph_number, 0::BIGINT AS adj_1, ends::BIGINT AS adj_2, (2 * coalesce(t, 0))::BIGINT AS adj_3, ends::BIGINT AS lap_1, (squares + ends)::BIGINT AS lap_2 FROM d LEFT JOIN t USING (g)""",
)
def f10_moments(spark, sf):
    """Power sums of the spectra, which count closed walks and degrees: what the eigenvalues have to add up to."""
    rows = ops.with_features(band(spark, sf), ["adj_spectrum", "lap_spectrum"])
    power = lambda c, k: F.round(F.aggregate(F.transform(c, lambda x: F.pow(x, F.lit(k))), F.lit(0.0), lambda x, y: x + y)).cast("long")
    return rows.select("graph_number", *[power("adj_spectrum", k).alias(f"adj_{k}") for k in (1, 2, 3)], *[power("lap_spectrum", k).alias(f"lap_{k}") for k in (1, 2)])


_features(
    "f11_automorphisms",
    ["aut_group_size"],
    """SELECT g AS graph_number, count(*) AS aut_group_size FROM (WITH RECURSIVE masks AS (SELECT g, list(a ORDER BY v) AS a FROM adj WHERE g IN (SELECT g FROM band) GROUP BY g),
    maps AS (SELECT g, a, []::BIGINT[] AS m FROM masks UNION ALL
      SELECT g, a, list_append(m, w) FROM maps JOIN (SELECT unnest(range(9)) AS w) ON len(m) < 9 AND NOT list_contains(m, w) AND bit_count(a[len(m) + 1]) = bit_count(a[w + 1])
        AND len([i FOR i IN range(len(m)) IF ((a[i + 1] >> len(m)::INT) & 1) <> ((a[m[i + 1] + 1] >> w::INT) & 1)]) = 0)
    SELECT g FROM maps WHERE len(m) = 9) GROUP BY g""",
)

_features(
    "f12_odd_cycle_transversal",
    ["odd_cycle_transversal"],
    """, ind AS (SELECT g, s, pc FROM sub WHERE e = 0 UNION ALL SELECT g, 0, 0 FROM band)
    SELECT x.g AS graph_number, 9 - max(x.pc + y.pc) AS odd_cycle_transversal FROM ind x JOIN ind y ON y.g = x.g AND y.s & x.s = 0 GROUP BY x.g""",
)
_features("f13_edge_frustration", ["edge_frustration"], "SELECT g AS graph_number, m - best_cut AS edge_frustration FROM band")

_native(
    "f14_separated_pairs",
    ["n_chordless_odd_cycles", "sep_pairs", "sep_pairs_3_3", "sep_pairs_3_5", "sep_pairs_other"],
    """SELECT b.g AS graph_number, (SELECT count(*) FROM oddc o WHERE o.g = b.g) AS n_chordless_odd_cycles, count(p.a) AS sep_pairs, count(p.a) FILTER (la + lb = 6) AS sep_pairs_3_3,
    count(p.a) FILTER (la + lb = 8) AS sep_pairs_3_5, count(p.a) FILTER (la + lb > 8) AS sep_pairs_other FROM band b LEFT JOIN pairs p USING (g) GROUP BY b.g""",
    cycles=True,
    found=_pair_counts,
)
_native("f15_normalization_gap", ["normalization_gap"], "SELECT b.g AS graph_number, count(DISTINCT p.a | p.b) AS normalization_gap FROM band b LEFT JOIN pairs p USING (g) GROUP BY b.g", cycles=True, found=_pair_counts)

LINK = """, link AS (SELECT p.g, p.a, p.b, p.la, p.lb, least(min(bit_count((p.a | s.s | s.near) & ~s.s)) FILTER (s.s & p.b = 0), bit_count(p.a))::INT AS linkage
  FROM pairs p JOIN sub s ON s.g = p.g GROUP BY p.g, p.a, p.b, p.la, p.lb)"""
_features("f16_same_block_pairs", ["sep_same_block_pairs"], LINK + " SELECT b.g AS graph_number, count(l.a) FILTER (linkage >= 2) AS sep_same_block_pairs FROM band b LEFT JOIN link l USING (g) GROUP BY b.g", cycles=True)

MEET = ", meet AS (SELECT c.g, c.s, c.len, c.c FROM cyc c WHERE c.len % 2 = 0 AND EXISTS (SELECT 1 FROM pairs p WHERE p.g = c.g AND p.a & c.s <> 0 AND p.b & c.s <> 0))"
_native(
    "f17_even_cycles_meeting_pair",
    ["even_cycles_meeting_pair", "even_cycle_meets_pair", "even_meeting_len_min"],
    MEET + " SELECT b.g AS graph_number, coalesce(sum(c), 0)::BIGINT AS even_cycles_meeting_pair, (count(s) > 0)::INT AS even_cycle_meets_pair, min(len) AS even_meeting_len_min FROM band b LEFT JOIN meet USING (g) GROUP BY b.g",
    cycles=True,
    found=_meeting,
)

_features(
    "f18_pair_geometry",
    ["sep_dist_min", "sep_dist_max", "sep_closest_geodesics", "sep_linkage_min", "sep_linkage_max", "sep_walk_degree_min", "sep_walk_degree_max", "sep_len_sum_min", "sep_len_sum_max"],
    LINK
    + """, hop AS (SELECT p.g, p.a, p.b, v.v AS pos, 0 AS d, 1::BIGINT AS paths FROM pairs p JOIN (SELECT unnest(range(9)) AS v) v ON (p.a >> v.v::INT) & 1 = 1
      UNION ALL SELECT h.g, h.a, h.b, e.w, h.d + 1, h.paths FROM hop h JOIN bend e ON e.g = h.g AND e.v = h.pos WHERE h.d < 6 AND (h.b >> h.pos::INT) & 1 = 0 AND (h.a >> e.w::INT) & 1 = 0),
    hit AS (SELECT g, a, b, d, sum(paths)::BIGINT AS paths FROM hop WHERE (b >> pos::INT) & 1 = 1 GROUP BY g, a, b, d),
    geo AS (SELECT l.*, h.d, h.paths FROM link l JOIN (SELECT g, a, b, min(d) AS d, arg_min(paths, d) AS paths FROM hit GROUP BY g, a, b) h USING (g, a, b)),
    low AS (SELECT g, min(d) AS d FROM geo GROUP BY g)
    SELECT b.g AS graph_number, min(x.d) AS sep_dist_min, max(x.d) AS sep_dist_max, max(x.paths) FILTER (x.d = low.d) AS sep_closest_geodesics, min(linkage) AS sep_linkage_min, max(linkage) AS sep_linkage_max,
    min((la + lb) // 2 + x.d) AS sep_walk_degree_min, max((la + lb) // 2 + x.d) AS sep_walk_degree_max, min(la + lb) AS sep_len_sum_min, max(la + lb) AS sep_len_sum_max
    FROM band b LEFT JOIN geo x USING (g) LEFT JOIN low ON low.g = b.g GROUP BY b.g""",
    cycles=True,
)

_features(
    "f19_standard_invariants",
    ["independence_number", "matching_number", "chromatic_number"],
    """, m1 AS (SELECT g, 0::BIGINT AS s FROM band UNION SELECT m1.g, m1.s | (1::BIGINT << e.i::INT) | (1::BIGINT << e.j::INT) FROM m1 JOIN edges e ON e.g = m1.g AND (m1.s >> e.i::INT) & 1 = 0 AND (m1.s >> e.j::INT) & 1 = 0),
    mm AS (SELECT g, max(bit_count(s))::INT // 2 AS k FROM m1 GROUP BY g),
    ind AS (SELECT g, s, pc FROM sub WHERE e = 0), two AS (SELECT DISTINCT x.g, x.s | y.s AS s FROM ind x JOIN ind y ON x.g = y.g AND x.s & y.s = 0),
    c3 AS (SELECT DISTINCT t.g FROM two t JOIN ind i ON i.g = t.g AND i.s = 511 - t.s), c4 AS (SELECT DISTINCT t.g FROM two t JOIN two u ON u.g = t.g AND u.s = 511 - t.s)
    SELECT b.g AS graph_number, (SELECT max(pc) FROM ind WHERE ind.g = b.g) AS independence_number, mm.k AS matching_number,
    CASE WHEN b.g IN (SELECT g FROM c3) THEN 3 WHEN b.g IN (SELECT g FROM c4) THEN 4 ELSE 5 END AS chromatic_number FROM band b JOIN mm USING (g)""",
    cycles=True,
)
_features("f19_treewidth", ["treewidth"], None)
_native("f20_hamiltonian", ["is_hamiltonian"], "SELECT b.g AS graph_number, count(c.s)::INT AS is_hamiltonian FROM band b LEFT JOIN cyc c ON c.g = b.g AND c.s = 511 GROUP BY b.g", cycles=True, found=_hamiltonian)
_native(
    "f21_components",
    ["n_components"],
    """r AS (SELECT g, v AS start, v FROM adj UNION SELECT r.g, r.start, e.w FROM r JOIN ends e ON e.g = r.g AND e.v = r.v), l AS (SELECT g, start, min(v) AS least FROM r GROUP BY g, start)
    SELECT g AS graph_number, count(*) FILTER (start = least) AS n_components FROM l GROUP BY g""",
    found=lambda spark, sf: structure.components(structure.with_masks(graphs(spark, sf))),
    head=f"RECURSIVE {ADJ},",
)


@query(
    "f22_c4_prediction",
    f"WITH RECURSIVE {CYCLES}{MEET} SELECT m, count(*) AS graphs, count(*) FILTER (g NOT IN (SELECT g FROM meet)) AS predicted_cm FROM band GROUP BY m",
)
def f22(spark, sf):
    rows = predict_c4(_meeting(spark, sf).join(structure.sizes(_masks(spark, sf)).select("graph_number", "m"), "graph_number"))
    return rows.groupBy("m").agg(F.count(F.lit(1)).alias("graphs"), F.sum("predicted_cm").alias("predicted_cm"))


def predict_c4(features):
    """The prediction, made before any result is known."""
    return features.withColumn("predicted_cm", 1 - F.col("even_cycle_meets_pair"))


@query("u01_all_features")
def u01(spark, sf):
    """The whole feature row of every graph of the band."""
    return ops.with_features(band(spark, sf), kernel.COLUMNS)


@query("u02_explode_pairs", f"WITH RECURSIVE {CYCLES} SELECT g AS graph_number, a, b, la AS len_a, lb AS len_b FROM pairs")
def u02(spark, sf):
    from graphmill.operators.relate import odd_cycles, sep_pairs

    return sep_pairs(odd_cycles(band(spark, sf)), "graph_number").select("graph_number", "a", "b", "len_a", "len_b")


@query(
    "m08_feature_cache",
    f"WITH {BAND} SELECT DISTINCT graph6, m FROM band",
)
def m08(spark, sf):
    rows = band(spark, sf)
    cached = ops.with_features(rows.filter("graph_number % 2 = 0").select("graph6").distinct(), ["m"])
    return ops.fill_cache(cached, rows, ["m"])
