"""Queries on reconciling run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.jobs.base import BEST, EDGES, RUNS, TEXTS, VERDICT, graphs, runs, table
from graphmill.operators import runs as ops
from graphmill.registry import query


@query("b05_latest_runs", f"WITH {BEST} SELECT graph_number, line_no, status FROM best")
def b05(spark, sf):
    return ops.latest_runs(runs(spark, sf)).select("graph_number", "line_no", "status")


LAST = RUNS + ", last AS (SELECT graph_number, max(line_no) AS line_no, arg_max(status, line_no) AS status FROM runs GROUP BY 1)"


@query("b06_load_done", f"WITH {LAST} SELECT graph_number, status, line_no FROM last WHERE status IN ('done', 'unconfirmed')")
def b06(spark, sf):
    return ops.load_done(runs(spark, sf), retry=True).select("graph_number", "status", "line_no")


@query("b06_load_done_any", f"WITH {LAST} SELECT graph_number, status, line_no FROM last")
def b06_any(spark, sf):
    return ops.load_done(runs(spark, sf), retry=False).select("graph_number", "status", "line_no")


def _parts(spark, sf):
    """Result lines of several machines: an event's file is its remainder by four; a done run is complete."""
    rows = runs(spark, sf)
    return rows.select("graph_number", (F.col("line_no") % 4).cast("int").alias("file_order"), "line_no", (F.col("status") == "done").alias("complete"), F.col("seconds").alias("cpu"))


PARTS = RUNS + ", parts AS (SELECT graph_number, (line_no % 4)::INT AS file_order, line_no, status = 'done' AS complete, seconds AS cpu FROM runs)"
MERGED = PARTS + ", merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_number ORDER BY NOT complete, file_order, line_no) AS rn FROM parts) WHERE rn = 1)"


@query("b07_merge_results", f"WITH {MERGED} SELECT graph_number, file_order, line_no, complete, cpu FROM merged")
def b07(spark, sf):
    return ops.merge_results(_parts(spark, sf))


@query(
    "b07_coverage",
    f"""WITH {EDGES}, {MERGED}, w AS (SELECT DISTINCT g FROM edges) SELECT (SELECT count(*) FROM merged) AS merged, (SELECT count(*) FROM merged WHERE complete) AS complete,
    (SELECT count(*) FROM merged WHERE NOT complete) AS failed, (SELECT count(*) FROM w WHERE g NOT IN (SELECT graph_number FROM merged)) AS missing""",
)
def b07_coverage(spark, sf):
    return ops.coverage(graphs(spark, sf).select("graph_number"), ops.merge_results(_parts(spark, sf)))


@query(
    "b08_latest_complete",
    f"WITH {PARTS} SELECT graph_number, file_order, line_no, cpu FROM (SELECT *, row_number() OVER (PARTITION BY graph_number ORDER BY file_order DESC, line_no DESC) AS rn FROM parts) WHERE rn = 1 AND complete",
)
def b08(spark, sf):
    return ops.latest_complete(_parts(spark, sf)).select("graph_number", "file_order", "line_no", "cpu")


@query("b10_failed_items", f"WITH {RUNS} SELECT graph_number FROM runs GROUP BY 1 HAVING bool_or(status IN ('timeout', 'error')) AND NOT bool_or(status IN ('done', 'unconfirmed'))")
def b10(spark, sf):
    return ops.failed_items(runs(spark, sf))


@query(
    "b11_nonnegative_h",
    f"WITH {TEXTS}, {RUNS}, h AS (SELECT DISTINCT graph_number FROM runs WHERE least(1, k - 10, 3) >= 0) SELECT graph_number, graph6 FROM h JOIN texts ON g = graph_number",
)
def b11(spark, sf):
    h = runs(spark, sf).select("graph_number", F.array(F.lit(1), F.col("k") - 10, F.lit(3)).alias("h"))
    return ops.nonneg(h, graphs(spark, sf)).select("graph_number", "graph6").distinct()


@query("b16_verdict", f"WITH {RUNS} SELECT line_no, {VERDICT} FROM runs")
def b16(spark, sf):
    v = ops.verdict(F.lit(9), F.col("depth_zzp"), F.col("decided_by"), F.col("depth"))
    return runs(spark, sf).select("line_no", v["is_cm"].alias("is_cm"), v["decided_by"].alias("verdict"))


@query(
    "b17_derive_results",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 + l_partkey % 3 AS a, 1 + l_suppkey % 3 AS b, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 9 - l_linenumber % 2 END AS depth,
      CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 2 END AS num_gens, 9 + 1 + l_partkey % 2 AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (depth = 9)::INT AS is_cm, '1,' || a || ',' || b AS h, (b = 1)::INT AS h_symmetric,
      CASE WHEN depth = 9 THEN (b = 1)::INT WHEN depth IS NOT NULL THEN 0 END AS is_gorenstein, num_gens, CASE num_gens WHEN 1 THEN '3' ELSE '2,3' END AS degrees,
      CASE WHEN num_gens = m - 9 THEN 1 ELSE 0 END AS is_ci FROM r""",
)
def b17(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    series = F.format_string("(1+%d*T+%d*T^2)/((1-T)^9)", 1 + F.col("l_partkey") % 3, 1 + F.col("l_suppkey") % 3)
    ideal = F.when(F.col("l_suppkey") % 4 == 0, "ideal(e_1*e_2^2-e_3*e_4*e_5)").otherwise("ideal(e_1*e_2^2-e_3*e_4*e_5, e_1*e_2-e_6^2)")
    depth = F.when(F.col("l_linenumber") % 3 != 0, 9 - F.col("l_linenumber") % 2).cast("int")
    rows = rows.select("*", F.lit(9).alias("n"), (10 + F.col("l_partkey") % 2).alias("m"), depth.alias("depth"), series.alias("hilbert_series"), ideal.alias("toric_ideal"), F.lit(1).alias("gens_minimal"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return ops.derive_results(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_cm", text("h_vector").alias("h"), "h_symmetric", "is_gorenstein", "num_gens", text("gen_degrees").alias("degrees"), "is_ci")


@query(
    "b18_upsert",
    f"""WITH {RUNS}, s AS (SELECT graph_number, line_no % 3 AS src, max(line_no) AS line_no, arg_max(seconds, line_no) AS seconds, CASE WHEN max(k) % 2 = 0 THEN max(k) END AS number FROM runs GROUP BY 1, 2)
    SELECT graph_number, arg_max(line_no, src) AS line_no, arg_max(seconds, src) AS seconds, arg_max(number, src) FILTER (number IS NOT NULL) AS number FROM s GROUP BY 1""",
)
def b18(spark, sf):
    rows = runs(spark, sf).groupBy("graph_number", (F.col("line_no") % 3).alias("src"))
    rows = rows.agg(F.max("line_no").alias("line_no"), F.max_by("seconds", "line_no").alias("seconds"), F.when(F.max("k") % 2 == 0, F.max("k")).alias("number"))
    sources = [rows.filter(F.col("src") == k).drop("src") for k in range(3)]
    return ops.upsert(sources, "graph_number", coalesced="number").select("graph_number", "line_no", "seconds", "number")


def _loaded(spark, sf):
    rows = runs(spark, sf).withColumn("n", F.lit(9)).withColumn("hilbert_series", F.when(F.col("k") % 3 != 0, "(1+T)/((1-T)^9)"))
    return ops.results_from_runs(rows.withColumn("seconds_depth_qq", F.when(F.col("depth").isNotNull(), F.col("seconds"))).withColumn("seconds_depth_zzp", F.col("seconds") / 2))


LOADED = f"WITH {BEST}, l AS (SELECT graph_number, line_no, k % 3 <> 0 AS has_result, CASE WHEN depth IS NOT NULL THEN seconds ELSE seconds / 2 END AS seconds_depth, {VERDICT} FROM best)"


@query("b19_results_from_runs", LOADED + " SELECT graph_number, line_no, has_result, seconds_depth, is_cm, verdict FROM l")
def b19(spark, sf):
    return _loaded(spark, sf).select("graph_number", "line_no", "has_result", "seconds_depth", "is_cm", F.col("decided_by").alias("verdict"))


@query("b19_load_counts", LOADED + " SELECT count(*) FILTER (has_result AND is_cm IS NOT NULL) AS decided, count(*) FILTER (NOT has_result OR is_cm IS NULL) AS undecided FROM l")
def b19_counts(spark, sf):
    return ops.load_counts(_loaded(spark, sf))


BLOCK_ROWS = (
    "WITH b AS (SELECT l_orderkey AS graph_number, 10 + (count(*) % 3)::INT AS m, CASE WHEN sum(l_quantity) % 2 = 0 THEN 9 ELSE 8 END AS depth, 1 + (max(l_partkey) % 3)::INT AS a, 1 + (max(l_suppkey) % 3)::INT AS b, (count(*) % 2)::INT AS one FROM lineitem GROUP BY 1)"
)


@query(
    "b19_results_from_blocks",
    f"""{BLOCK_ROWS} SELECT graph_number, 'H' || graph_number AS graph6, depth, '1,' || a || ',' || b AS h, (b = 1)::INT AS h_symmetric, (depth = 9)::INT AS is_cm, CASE WHEN depth = 9 THEN (b = 1)::INT ELSE 0 END AS is_gorenstein,
    CASE WHEN one = 1 THEN 1 ELSE 2 END AS num_gens, CASE WHEN one = 1 THEN '5' ELSE '2,5' END AS degrees, CASE WHEN (CASE WHEN one = 1 THEN 1 ELSE 2 END) = m - 9 THEN 1 ELSE 0 END AS is_ci, 0.25::DOUBLE AS seconds_depth FROM b""",
)
def b19_blocks(spark, sf):
    """Solver blocks written from the line items' orders, read back and loaded as results."""
    from graphmill.scratch import new_path
    from graphmill.sources import text

    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    ideal = F.when(F.col("c") % 2 == 1, "ideal(e_2*e_3*e_5*e_7^2-e_1*e_4^2*e_6*e_8)").otherwise("ideal(e_4*e_8-e_3*e_9,e_1*e_5*e_7*e_9^2-e_2*e_6^2*e_8*e_3)")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    block = F.concat_ws(
        "\n", field("GraphNumber", F.col("l_orderkey")), field("Graph6", F.concat(F.lit("H"), F.col("l_orderkey"))), field("NumEdges", 10 + F.col("c") % 3), field("ToricIdeal", ideal), field("Depth", F.when(F.col("q") % 2 == 0, 9).otherwise(8)),
        field("ReducedHilbertSeries", F.format_string("(1+%d*T+%d*T^2)/((1-T)^9)", 1 + F.col("p") % 3, 1 + F.col("s") % 3)), F.lit("SecondsKer: .5"), F.lit("SecondsDepth: .25"), F.lit("SecondsHilbert: .125"), F.lit("===="),
    )
    path = new_path(spark, "result-blocks")
    rows.select(block.alias("value")).write.text(path)
    found = ops.derive_results(ops.results_from_blocks(text.read_blocks(spark, path)).withColumn("n", F.lit(9)))
    joined = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return found.select("graph_number", "graph6", "depth", joined("h_vector").alias("h"), "h_symmetric", "is_cm", "is_gorenstein", "num_gens", joined("gen_degrees").alias("degrees"), "is_ci", "seconds_depth")


#: Stage seconds of a solver block, and depths that were measured again for some.
STAGES = """st AS (SELECT l_orderkey AS graph_number, sum(l_quantity)::BIGINT AS q, count(*) AS c, max(l_partkey) AS p FROM lineitem GROUP BY 1),
blocks AS (SELECT graph_number, (q % 7) / 8.0::DOUBLE AS seconds_ker, (p % 5) / 16.0::DOUBLE AS seconds_hilbert, (q % 3) / 4.0::DOUBLE AS seconds_depth, CASE WHEN c % 2 = 1 THEN 5 ELSE 2 + (p % 4) END AS top FROM st),
again AS (SELECT graph_number, (p % 9) / 2.0::DOUBLE AS seconds FROM st WHERE graph_number % 3 = 0)"""


def _stage_blocks(spark, sf):
    """Solver blocks written from the line items' orders and read back, and depths measured again, as lines."""
    from graphmill.scratch import new_path
    from graphmill.sources import text

    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("c"), F.max("l_partkey").alias("p"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    degrees = F.when(F.col("c") % 2 == 1, F.lit("{2, 5}")).otherwise(F.format_string("{2, %d}", 2 + F.col("p") % 4))
    block = F.concat_ws(
        "\n", field("GraphNumber", F.col("l_orderkey")), field("GenDegrees", degrees), field("SecondsKer", F.col("q") % 7 / 8), field("SecondsHilbert", F.col("p") % 5 / 16), field("SecondsDepth", F.col("q") % 3 / 4), F.lit("===="),
    )
    path, lines = new_path(spark, "stage-blocks"), new_path(spark, "depth-again")
    rows.select(block.alias("value")).write.text(path)
    rows.filter("l_orderkey % 3 = 0").select(F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.lit("9"), (F.col("p") % 9 / 2).cast("string")).alias("value")).write.text(lines)
    kv = F.col("kv")
    seconds = [kv[f"Seconds{name}"].try_cast("double").alias(f"seconds_{name.lower()}") for name in ("Ker", "Hilbert", "Depth")]
    blocks = text.read_blocks(spark, path).select(kv["GraphNumber"].cast("long").alias("graph_number"), kv["GenDegrees"].alias("gen_degrees"), *seconds)
    return blocks, text.depth_lines(spark.read.text(lines))


@query(
    "g12_cost_by_stage",
    f"WITH {STAGES} SELECT graph_number, seconds_ker, seconds_hilbert, coalesce(seconds, 0) AS seconds_again, seconds_ker + seconds_hilbert + coalesce(seconds, 0) AS cost, seconds_ker + seconds_hilbert + seconds_depth AS cpu_total FROM blocks LEFT JOIN again USING (graph_number)",
)
def g12_stages(spark, sf):
    """What a graph costs: the stages of its block, and its depth only where that was measured again."""
    return ops.stage_costs(*_stage_blocks(spark, sf))


@query(
    "g05_block_histograms",
    f"WITH {STAGES} SELECT 'max_gen_degree' AS what, top::VARCHAR AS value, count(*)::DOUBLE AS n FROM blocks GROUP BY 2 UNION ALL SELECT 'seconds', stage, round(sum(s), 4) FROM (UNPIVOT blocks ON seconds_ker, seconds_hilbert, seconds_depth INTO NAME stage VALUE s) GROUP BY stage",
)
def g05_blocks(spark, sf):
    """Largest generator degrees, and the seconds of each stage in all."""
    from graphmill.functions import parsing

    blocks, _ = _stage_blocks(spark, sf)
    top = F.array_max(parsing.gen_degrees(F.col("gen_degrees"))).cast("string")
    degrees = blocks.groupBy(top.alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("max_gen_degree").alias("what"), "value", "n")
    spent = blocks.unpivot([], ["seconds_ker", "seconds_hilbert", "seconds_depth"], "value", "s").groupBy("value").agg(F.round(F.sum("s"), 4).alias("n"))
    return degrees.unionByName(spent.select(F.lit("seconds").alias("what"), "value", "n"))


@query(
    "s04_stuck_items",
    f"""WITH {TEXTS}, {RUNS}, p AS (SELECT g, row_number() OVER (ORDER BY g) AS position FROM texts), f AS (SELECT DISTINCT graph_number FROM runs WHERE status IN ('done', 'unconfirmed'))
    SELECT (position - 1) // 50 AS batch, arg_min(g, position) AS graph_number FROM p WHERE g NOT IN (SELECT graph_number FROM f) GROUP BY 1""",
)
def s04(spark, sf):
    from graphmill.operators.corpus import assign_batches, numbered

    batches = assign_batches(numbered(graphs(spark, sf).select("graph_number"), "graph_number"), 50)
    return ops.stuck_items(batches, runs(spark, sf).filter(ops.is_final()).select("graph_number").distinct())

