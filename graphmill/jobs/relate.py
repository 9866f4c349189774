"""Queries that join features with results and tabulate them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.jobs.base import BEST, CYCLES, RUNS, TEXTS, VERDICT, band, edges, graphs, runs, spread, table
from graphmill.jobs.features import MEET
from graphmill.operators import corpus, relate as ops, runs as run_ops
from graphmill.registry import query

FEATURES = ["n", "m", "fails_occ", "sep_pairs", "even_cycle_meets_pair", "n_bridges", "is_hamiltonian", "n_triangles"]

JOINED = (
    f"WITH RECURSIVE {CYCLES}{MEET}, {BEST}, bridges AS (SELECT e.g, count(DISTINCT e.i * 9 + e.j) AS n FROM edges e JOIN cuts c ON c.g = e.g AND c.cut = 1 AND ((c.s >> e.i::INT) & 1) <> ((c.s >> e.j::INT) & 1) GROUP BY e.g), "
    f"""verdicts AS (SELECT graph_number, k, seconds, status, depth, depth_zzp, {VERDICT} FROM best),
joined AS (SELECT b.g AS graph_number, b.graph6, 9 AS n, b.m, (b.g IN (SELECT g FROM pairs))::INT AS fails_occ, (b.g IN (SELECT g FROM meet))::INT AS even_cycle_meets_pair, coalesce(r.n, 0) AS n_bridges,
  (EXISTS (SELECT 1 FROM cyc WHERE cyc.g = b.g AND cyc.s = 511))::INT AS is_hamiltonian, (SELECT count(*) FROM cyc WHERE cyc.g = b.g AND cyc.len = 3) AS n_triangles, v.k, v.seconds, v.status, v.depth, v.is_cm, v.verdict,
  CASE WHEN v.is_cm IS NULL THEN NULL WHEN v.is_cm = 0 THEN 0 ELSE (v.k % 2 = 0)::INT END AS is_gorenstein, CASE WHEN v.is_cm = 1 THEN (v.k % 4 = 0)::INT WHEN v.is_cm = 0 THEN 0 END AS is_ci
  FROM band b LEFT JOIN verdicts v ON v.graph_number = b.g LEFT JOIN bridges r ON r.g = b.g)"""
)


def verdicts(spark, sf):
    best = run_ops.latest_runs(runs(spark, sf))
    v = run_ops.verdict(F.lit(9), F.col("depth_zzp"), F.col("decided_by"), F.col("depth"))
    return best.select(F.lit(9).cast("long").alias("n"), "graph_number", "k", "seconds", "status", "depth", v["is_cm"].alias("is_cm"), v["decided_by"].alias("verdict"))


def joined(spark, sf, more=()):
    """Features (and those of ``more``) with the verdict of the best run, left: a graph that was not run is unknown. Numbers
    repeat across n."""
    rows = corpus.with_features(spread(band(spark, sf)), [*FEATURES, *more]).join(verdicts(spark, sf), ["n", "graph_number"], "left")
    cm, k = F.col("is_cm"), F.col("k")
    return rows.withColumn("is_gorenstein", F.when(cm == 0, 0).when(cm == 1, (k % 2 == 0).cast("int"))).withColumn("is_ci", F.when(cm == 1, (k % 4 == 0).cast("int")).when(cm == 0, 0))


J01 = ["graph_number", "m", "fails_occ", "is_cm", "verdict"]


@query("j01_features_results", f"{JOINED} SELECT {', '.join(J01)} FROM joined")
def j01(spark, sf):
    return joined(spark, sf).select(*J01)


@query("j01_modelling_inner", f"{JOINED} SELECT {', '.join(J01)} FROM joined WHERE is_cm IS NOT NULL")
def j01_inner(spark, sf):
    known = verdicts(spark, sf).filter("is_cm is not null")
    return corpus.with_features(band(spark, sf), ["n", "m", "fails_occ"]).join(known, ["n", "graph_number"]).select(*J01)


CATEGORY = "CASE WHEN v.graph_number IS NULL THEN 'no run' WHEN v.depth IS NULL THEN 'no depth' ELSE 'depth' END"


@query("j02_missing_categories", f"WITH {TEXTS}, {BEST} SELECT {CATEGORY} AS category, count(*) AS n FROM texts t LEFT JOIN best v ON v.graph_number = t.g GROUP BY 1")
def j02(spark, sf):
    rows = graphs(spark, sf).select("graph_number").join(run_ops.latest_runs(runs(spark, sf)).withColumn("run", F.lit(True)), "graph_number", "left")
    category = F.when(F.col("run").isNull(), "no run").when(F.col("depth").isNull(), "no depth").otherwise("depth")
    return ops.histogram(rows.select(category.alias("category")), "category")


@query(
    "j03_source_agreement",
    "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 1), "
    "u AS (SELECT k, count(*) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY k) SELECT count(*) FILTER (s = 3) AS agreed, count(*) FILTER (s < 3) AS differing FROM u",
)
def j03(spark, sf):
    lines = table(spark, sf, "lineitem")
    key = lambda df, c: df.select(F.col(c).alias("k"))
    return ops.same_keys([key(lines, "l_orderkey"), key(table(spark, sf, "orders"), "o_orderkey"), key(lines.filter("l_quantity > 1"), "l_orderkey")], "k")


@query(
    "j04_set_algebra",
    f"""{JOINED} SELECT count(*) FILTER (fails_occ = 0 AND is_cm = 1) AS predicted_cm_and_cm, count(*) FILTER (fails_occ = 0 AND is_cm = 0) AS predicted_cm_not_cm, count(*) FILTER (is_cm = 1 AND fails_occ = 1) AS cm_not_predicted,
    count(*) FILTER (is_gorenstein = 1 AND is_ci = 0) AS gorenstein_not_ci, count(*) FILTER (is_ci = 1 AND is_gorenstein = 0) AS ci_not_gorenstein, count(*) FILTER (is_cm IS NULL) AS undecided FROM joined""",
)
def j04(spark, sf):
    fails, cm, gor, ci = (F.col(c) for c in ("fails_occ", "is_cm", "is_gorenstein", "is_ci"))
    return ops.set_algebra(
        joined(spark, sf),
        {
            "predicted_cm_and_cm": (fails == 0) & (cm == 1), "predicted_cm_not_cm": (fails == 0) & (cm == 0), "cm_not_predicted": (cm == 1) & (fails == 1),
            "gorenstein_not_ci": (gor == 1) & (ci == 0), "ci_not_gorenstein": (ci == 1) & (gor == 0), "undecided": cm.isNull(),
        },
    )


@query("j05_theta_self_join", f"WITH RECURSIVE {CYCLES} SELECT g AS graph_number, count(*) AS pairs, min(la + lb) AS shortest FROM pairs GROUP BY g")
def j05(spark, sf):
    found = ops.sep_pairs(ops.odd_cycles(band(spark, sf)), "graph_number")
    return found.groupBy("graph_number").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.col("len_a") + F.col("len_b")).alias("shortest"))


@query("j06_semi_join", f"WITH RECURSIVE {CYCLES} SELECT o.g AS graph_number, o.s AS mask FROM oddc o WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.g = o.g AND o.s & p.a <> 0)")
def j06(spark, sf):
    cycles = ops.odd_cycles(band(spark, sf))
    pairs = ops.sep_pairs(cycles, "graph_number").select(F.col("graph_number").alias("p_graph"), "a")
    meets = (F.col("graph_number") == F.col("p_graph")) & (F.col("mask").bitwiseAND(F.col("a")) != 0)
    return cycles.join(pairs, meets, "left_semi").select("graph_number", "mask")


@query("j07_anti_join", f"WITH {TEXTS}, {RUNS} SELECT g AS graph_number FROM texts WHERE g NOT IN (SELECT graph_number FROM runs)")
def j07(spark, sf):
    return graphs(spark, sf).select("graph_number").join(runs(spark, sf), "graph_number", "left_anti")


@query("j08_union_sources", f"WITH {TEXTS} SELECT DISTINCT graph6 FROM texts WHERE m % 3 <> 1")
def j08(spark, sf):
    from graphmill.functions.graph6 import num_edges

    rows = graphs(spark, sf).withColumn("m", num_edges(F.col("graph6")))
    return rows.filter("m % 3 = 0").select("graph6").unionByName(rows.filter("m % 3 = 2 or m % 6 = 3").select("graph6")).dropDuplicates()


@query(
    "g01_corpus_summary",
    f"{JOINED} SELECT n, fails_occ, is_cm, count(*) AS graphs, coalesce(sum(is_gorenstein), 0)::BIGINT AS gorenstein, coalesce(sum(coalesce(is_ci, 0)), 0)::BIGINT AS ci, grouping(n, fails_occ, is_cm) AS level FROM joined GROUP BY ROLLUP (n, fails_occ, is_cm)",
)
def g01(spark, sf):
    out = joined(spark, sf).rollup("n", "fails_occ", "is_cm")
    return out.agg(F.count(F.lit(1)).alias("graphs"), F.coalesce(F.sum("is_gorenstein"), F.lit(0)).alias("gorenstein"), F.sum(F.coalesce("is_ci", F.lit(0))).alias("ci"), F.grouping_id().alias("level"))


@query(
    "g02_scorecard",
    f"""{JOINED}, k AS (SELECT graph_number, 1 - even_cycle_meets_pair AS p, is_cm AS t FROM joined WHERE is_cm IS NOT NULL AND fails_occ = 1),
    c AS (SELECT count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t = 1) AS fn, count(*) FILTER (p = 0 AND t = 0) AS tn FROM k)
    SELECT tp, fp, fn, tn, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
    coalesce((SELECT string_agg(graph_number::VARCHAR, ',' ORDER BY graph_number) FROM (SELECT graph_number FROM k WHERE p <> t ORDER BY 1 LIMIT 30)), '') AS counterexamples FROM c""",
)
def g02(spark, sf):
    return ops.scorecard(joined(spark, sf).filter("fails_occ = 1").withColumn("predicted", 1 - F.col("even_cycle_meets_pair")), "predicted", "is_cm", "graph_number")


#: What a failing graph is in the summary of a run, in SQL that DuckDB and Spark read alike. ``final``: its best record
#: has a series; the rest follow from that record.
FINAL = "status IN ('done', 'unconfirmed')"
RUN_PARTS = {
    "done": FINAL, "failed": "status IN ('timeout', 'error')", "missing": "status IS NULL", "negative": f"{FINAL} AND verdict = 'negative_h'", "nonnegative": f"{FINAL} AND verdict IS DISTINCT FROM 'negative_h'",
    "proven": f"{FINAL} AND is_cm = 1", "depth_missing": f"{FINAL} AND verdict IS NULL", "screened": f"{FINAL} AND verdict IN ('screen_ZZp', 'depth_QQ') AND is_cm IS DISTINCT FROM 1",
}
LISTED = ["failed", "depth_missing", "screened"]


def _failing(spark, sf):
    return joined(spark, sf).filter("fails_occ = 1")


@query(
    "g03_run_summary",
    f"""{JOINED}, s AS (SELECT count(*) AS failing, {", ".join(f"count(*) FILTER ({c}) AS {name}" for name, c in RUN_PARTS.items())}, coalesce(round(sum(seconds) FILTER ({FINAL}) / 3600, 6), 0) AS hours FROM joined WHERE fails_occ = 1)
    SELECT *, screened = 0 AND depth_missing = 0 AND failed = 0 AND done = failing AS holds_so_far FROM s""",
)
def g03(spark, sf):
    """The conjecture that nothing non-negative is short of depth holds so far if nothing is screened, missing or failed
    and every failing graph is done."""
    parts = [F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(name) for name, c in RUN_PARTS.items()]
    hours = F.coalesce(F.round(F.sum(F.when(F.expr(FINAL), F.col("seconds"))) / 3600, 6), F.lit(0.0))
    row = _failing(spark, sf).agg(F.count(F.lit(1)).alias("failing"), *parts, hours.alias("hours"))
    return row.withColumn("holds_so_far", F.expr("screened = 0 AND depth_missing = 0 AND failed = 0 AND done = failing"))


@query("g03_run_ids", f"{JOINED} " + " UNION ALL ".join(f"SELECT '{name}' AS what, graph_number FROM joined WHERE fails_occ = 1 AND {RUN_PARTS[name]}" for name in LISTED))
def g03_ids(spark, sf):
    """The summary's lists, a row for each graph."""
    hits = F.filter(F.array(*[F.when(F.expr(RUN_PARTS[name]), F.lit(name)) for name in LISTED]), lambda x: x.isNotNull())
    return _failing(spark, sf).select(F.explode(hits).alias("what"), "graph_number")


@query("g04_hamiltonian_by_status", f"{JOINED} SELECT is_hamiltonian, coalesce(verdict, 'unknown') AS verdict, count(*) AS n, count(*) FILTER (is_cm = 1) AS cm FROM joined GROUP BY 1, 2")
def g04(spark, sf):
    return ops.contingency(joined(spark, sf).withColumn("verdict", F.coalesce("verdict", F.lit("unknown"))), ["is_hamiltonian", "verdict"], cm=F.col("is_cm") == 1)


@query("g04_counterexamples", f"{JOINED} SELECT graph_number, graph6, m FROM joined WHERE fails_occ = 1 AND is_hamiltonian = 1 AND is_cm = 1")
def g04_counterexamples(spark, sf):
    return _failing(spark, sf).filter("is_hamiltonian = 1 AND is_cm = 1").select("graph_number", "graph6", "m")


@query(
    "g05_histograms",
    f"{JOINED} SELECT 'verdict' AS what, coalesce(verdict, 'none') AS value, count(*) AS n FROM joined GROUP BY 1, 2 UNION ALL SELECT 'n_triangles', n_triangles::VARCHAR, count(*) FROM joined GROUP BY 1, 2 UNION ALL SELECT 'm', m::VARCHAR, count(*) FROM joined GROUP BY 1, 2",
)
def g05(spark, sf):
    rows = joined(spark, sf).select(F.coalesce("verdict", F.lit("none")).alias("verdict"), F.col("n_triangles").cast("string").alias("n_triangles"), F.col("m").cast("string").alias("m"))
    return rows.unpivot([], ["verdict", "n_triangles", "m"], "what", "value").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g07_rates_by_edges",
    f"{JOINED} SELECT m, count(*) AS n, count(*) FILTER (fails_occ = 1) AS failing, count(*) FILTER (is_cm = 1) AS cm, count(*) FILTER (even_cycle_meets_pair = 0) AS predicted FROM joined GROUP BY m",
)
def g07(spark, sf):
    return ops.contingency(joined(spark, sf), ["m"], failing=F.col("fails_occ") == 1, cm=F.col("is_cm") == 1, predicted=F.col("even_cycle_meets_pair") == 0)


@query(
    "g08_edge_threshold",
    f"{JOINED} SELECT r.m, (f.m IS NOT NULL) AS seen FROM (SELECT unnest(range(10, 28)) AS m) r LEFT JOIN (SELECT DISTINCT m FROM joined WHERE fails_occ = 1) f USING (m)",
)
def g08(spark, sf):
    seen = corpus.with_features(band(spark, sf), ["m", "fails_occ"]).filter("fails_occ = 1").select("m", F.lit(True).alias("seen")).distinct()
    return spark.range(10, 28).withColumnRenamed("id", "m").join(seen, "m", "left").select("m", F.coalesce("seen", F.lit(False)).alias("seen"))


@query(
    "g09_integrity_rules",
    f"""{JOINED} SELECT 'occ_means_pairs' AS rule, count(*) FILTER (NOT ((graph_number IN (SELECT g FROM pairs)) = (fails_occ = 1))) AS violations FROM joined UNION ALL
    SELECT 'satisfied_means_cm', count(*) FILTER (fails_occ = 0 AND is_cm = 0) FROM joined UNION ALL SELECT 'ci_means_gorenstein', count(*) FILTER (is_ci = 1 AND is_gorenstein = 0) FROM joined UNION ALL
    SELECT 'edges_in_band', count(*) FILTER (m NOT BETWEEN 10 AND 27) FROM joined UNION ALL SELECT 'unique_number', (count(*) - count(DISTINCT graph_number)) FROM joined""",
)
def g09(spark, sf):
    c = F.col
    rows = joined(spark, sf)
    twice = rows.groupBy("n", "graph_number").agg(F.count(F.lit(1)).alias("rows")).agg(F.lit("unique_number").alias("rule"), F.coalesce(F.sum(c("rows") - 1), F.lit(0)).alias("violations"))
    rules = {
        "occ_means_pairs": (c("sep_pairs") > 0) == (c("fails_occ") == 1), "satisfied_means_cm": (c("fails_occ") == 1) | (c("is_cm") == 1), "ci_means_gorenstein": (c("is_ci") == 0) | (c("is_gorenstein") == 1),
        "edges_in_band": c("m").between(10, 27),
    }
    return ops.check_rules(rows, rules).unionByName(twice)


@query(
    "g11_progress",
    f"""WITH {TEXTS}, {BEST}, r AS (SELECT count(*) FILTER (status IN ('done', 'unconfirmed')) AS done, count(*) FILTER (status = 'timeout') AS timeouts, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (depth_zzp = 9) AS found,
    sum(seconds) AS seconds FROM best WHERE graph_number IN (SELECT g FROM texts)) SELECT done, timeouts, errors, found, (SELECT count(*) FROM texts) - done AS remaining, round(seconds, 4) AS elapsed, round(done / seconds, 6) AS rate,
    round(((SELECT count(*) FROM texts) - done) * seconds / done, 2) AS eta FROM r""",
)
def g11(spark, sf):
    """Best records of the graphs of the corpus, and the seconds that the rest takes at the rate so far."""
    s = F.col("status")
    own = graphs(spark, sf).select("graph_number")
    rows = own.join(run_ops.latest_runs(runs(spark, sf)), "graph_number", "left").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(s.isin("done", "unconfirmed")).alias("done"), F.count_if(s == "timeout").alias("timeouts"), F.count_if(s == "error").alias("errors"), F.count_if(F.col("depth_zzp") == 9).alias("found"), F.sum("seconds").alias("seconds"),
    )
    left = F.col("all") - F.col("done")
    return rows.select("done", "timeouts", "errors", "found", left.alias("remaining"), F.round("seconds", 4).alias("elapsed"), F.round(F.try_divide("done", "seconds"), 6).alias("rate"), F.round(F.try_divide(left * F.col("seconds"), "done"), 2).alias("eta"))


@query("g12_cost", f"WITH {RUNS} SELECT graph_number, round(sum(seconds), 6) AS cpu, round(sum(coalesce(CASE WHEN depth IS NOT NULL THEN seconds END, 0)), 6) AS depth_cpu FROM runs GROUP BY 1")
def g12(spark, sf):
    return runs(spark, sf).groupBy("graph_number").agg(F.round(F.sum("seconds"), 6).alias("cpu"), F.round(F.sum(F.coalesce(F.when(F.col("depth").isNotNull(), F.col("seconds")), F.lit(0.0))), 6).alias("depth_cpu"))


@query(
    "g13_profile",
    "SELECT 'l_quantity' AS \"column\", count(DISTINCT l_quantity) AS \"values\" FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem",
)
def g13(spark, sf):
    return ops.profile(table(spark, sf, "lineitem").withColumn("one", F.lit(1)), ["l_quantity", "l_discount", "l_linenumber", "one"])


STATUS = (
    "CASE WHEN fails_occ = 0 THEN 'satisfies OCC' WHEN verdict = 'screen_ZZp' THEN 'fails OCC · screened not CM (unproven)' WHEN is_cm IS NULL THEN 'fails OCC · not computed yet' "
    "WHEN is_cm = 1 THEN 'fails OCC · CM' ELSE 'fails OCC · not CM' END"
)


@query("b20_status_labels", f"{JOINED} SELECT graph_number, {STATUS} AS status_label, 'n=9 #' || graph_number AS name FROM joined")
def b20(spark, sf):
    label = ops.status(F.col("fails_occ"), F.col("verdict"), F.col("is_cm"))
    return joined(spark, sf).select("graph_number", label.alias("status_label"), F.format_string("n=%d #%d", "n", "graph_number").alias("name"))


@query("b22_filters", f"{JOINED} SELECT graph_number, m, n_triangles FROM joined WHERE n = 9 AND m BETWEEN 11 AND 14 AND fails_occ = 0 AND n_triangles BETWEEN 1 AND 3 AND n_bridges BETWEEN 0 AND 1")
def b22(spark, sf):
    spec = {"n": [9], "m": (11, 14), "equal": {"fails_occ": 0}, "ranges": {"n_triangles": (1, 3), "n_bridges": (0, 1)}}
    return ops.apply_filters(joined(spark, sf), spec).select("graph_number", "m", "n_triangles")


@query(
    "b23_lookup",
    f"WITH {TEXTS}, first AS (SELECT graph6 FROM texts ORDER BY g LIMIT 1) SELECT 'text' AS way, g AS graph_number FROM texts WHERE graph6 = (SELECT graph6 FROM first) UNION ALL SELECT 'number', g FROM texts WHERE g = 17 UNION ALL SELECT 'n:number', g FROM texts WHERE g = 18",
)
def b23(spark, sf):
    rows = graphs(spark, sf).withColumn("n", F.lit(9))
    text = rows.orderBy("graph_number").first()["graph6"]
    out = None
    for way, q in (("text", text), ("number", "17"), ("n:number", "9:18")):
        one = ops.lookup(rows, q).select(F.lit(way).alias("way"), "graph_number")
        out = one if out is None else out.unionByName(one)
    return out


@query("b24_page", f"WITH {TEXTS} SELECT g AS graph_number, m, graph6 FROM texts ORDER BY m, g LIMIT 24 OFFSET 48")
def b24(spark, sf):
    m = edges(spark, sf).groupBy("graph_number").agg(F.count(F.lit(1)).alias("m"))
    return ops.page(graphs(spark, sf).join(m, "graph_number"), "m", 2).select("graph_number", "m", "graph6")


@query("b24_bounds", f"WITH {TEXTS} SELECT min(m) AS low, max(m) AS high FROM texts")
def b24_bounds(spark, sf):
    return edges(spark, sf).groupBy("graph_number").agg(F.count(F.lit(1)).alias("m")).agg(F.min("m").alias("low"), F.max("m").alias("high"))


@query(
    "b25_label_set",
    f"{JOINED}, l AS (SELECT graph_number, m, (verdict IS DISTINCT FROM 'negative_h') AS h_nonneg, (verdict = 'negative_h' OR coalesce(is_cm, 0) = 1) AS label_proved, coalesce(is_cm, 0) AS label FROM joined WHERE verdict IS NOT NULL) "
    "SELECT graph_number, m, h_nonneg, label_proved, label FROM l WHERE h_nonneg UNION ALL SELECT * FROM (SELECT graph_number, m, h_nonneg, label_proved, 0 FROM l WHERE NOT h_nonneg ORDER BY md5('5:' || graph_number), graph_number LIMIT 20)",
)
def b25(spark, sf):
    rows = joined(spark, sf).filter("verdict is not null").select("graph_number", "m", (F.col("verdict") != "negative_h").alias("h_nonneg"), ((F.col("verdict") == "negative_h") | (F.coalesce("is_cm", F.lit(0)) == 1)).alias("label_proved"), F.coalesce("is_cm", F.lit(0)).alias("label"))
    sample = rows.filter(~F.col("h_nonneg")).orderBy(F.md5(F.concat(F.lit("5:"), F.col("graph_number"))), "graph_number").limit(20).withColumn("label", F.lit(0))
    return rows.filter("h_nonneg").unionByName(sample)

