"""Queries on reading, decoding, filtering and numbering the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import graph6 as g6
from graphmill.jobs.base import ADJ, BAND, CYCLES, EDGES, TEXTS, band, edges, graphs, runs, table
from graphmill.operators import corpus as ops
from graphmill.registry import query
from graphmill.scratch import new_path, written
from graphmill.sources import text

FAILING = ", failing AS (SELECT DISTINCT g FROM pairs)"


@query("a01_read_graph_list", f"WITH {TEXTS} SELECT g AS graph_number, graph6 FROM texts")
def a01(spark, sf):
    path = new_path(spark, "graph-list")
    graphs(spark, sf).select(F.concat_ws(" ", F.col("graph_number").cast("string"), "graph6").alias("value")).write.text(path)
    return text.read_graph_list(spark, path)


@query(
    "a02_ordered_lines",
    "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS line_no, l_orderkey || ' ' || l_linenumber AS value FROM lineitem",
)
def a02(spark, sf):
    path = new_path(spark, "lines")
    rows = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows.select(F.concat_ws(" ", "l_orderkey", "l_linenumber").alias("value")).write.text(path)
    return text.ordered_lines(spark, path).select("line_no", "value")


@query(
    "a03_read_run_log",
    "SELECT user_id AS graph_number, event_type AS status, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS depth, value AS seconds_ker FROM events WHERE event_id % 11 <> 5",
)
def a03(spark, sf):
    events = table(spark, sf, "events")
    depth = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k").cast("int"))
    line = F.to_json(F.struct(F.col("user_id").alias("graph_number"), F.col("event_type").alias("status"), depth.alias("depth"), F.col("value").alias("seconds_ker")))
    torn = F.when(F.col("event_id") % 11 == 5, F.left(line, F.length(line) - 4)).otherwise(line)
    path = new_path(spark, "run-log")
    events.select(torn.alias("value")).write.text(path)
    return text.run_records(spark.read.text(path)).select("graph_number", "status", "depth", "seconds_ker")


@query(
    "a04_read_blocks",
    "SELECT l_orderkey AS graph_number, (sum(l_quantity))::BIGINT AS depth, 'part ' || max(l_partkey) AS ideal, count(*) AS fields FROM lineitem GROUP BY l_orderkey",
)
def a04(spark, sf):
    path = new_path(spark, "blocks")
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.max("l_partkey").alias("p"), F.count(F.lit(1)).alias("c"))
    lines = F.concat_ws("\n", F.concat(F.lit("GraphNumber: "), F.col("l_orderkey")), F.lit("Depth: -1"), F.concat(F.lit("Depth:  "), F.col("q")), F.concat(F.lit("Ideal: part "), F.col("p")), F.lit("===="), F.concat(F.lit("Fields: "), F.col("c")))
    per.select(lines.alias("value")).write.text(path)
    kv = F.col("kv")
    return text.read_blocks(spark, path).select(kv["GraphNumber"].cast("long").alias("graph_number"), kv["Depth"].cast("long").alias("depth"), kv["Ideal"].alias("ideal"), kv["Fields"].cast("long").alias("fields"))


A05 = "CASE WHEN l_linenumber = 1 THEN 'TIMEOUT' END"


@query(
    "a05_hilbert_and_depth_lines",
    f"""SELECT l_orderkey AS graph_number, l_linenumber AS line_no, {A05} IS NULL AS complete, {A05} AS failure, CASE WHEN {A05} IS NULL THEN l_partkey % 50 END AS num_gens,
    CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS depth FROM lineitem""",
)
def a05(spark, sf):
    rows = table(spark, sf, "lineitem")
    number = F.col("l_orderkey").cast("string")
    whole = F.concat_ws("\t", number, (F.col("l_partkey") % 50).cast("string"), F.lit("{2, 3}"), F.lit("(1+T)/((1-T)^9)"), F.col("l_tax").cast("string"))
    line = F.when(F.col("l_linenumber") == 1, F.concat_ws("\t", number, F.lit("TIMEOUT"), F.lit("9.5"))).otherwise(whole)
    depth = F.concat_ws(" ", number, F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise("ERROR"), F.lit(".25"))
    lines = rows.select(F.col("l_linenumber").alias("line_no"), line.alias("value"), text.depth_fields(depth)["depth"].cast("long").alias("depth"))
    return text.hilbert_lines(lines).select("graph_number", "line_no", "complete", "failure", F.col("num_gens").cast("long").alias("num_gens"), "depth")


@query("a06_predictions_file", f"WITH {TEXTS} SELECT g AS graph_number, graph6, m, (m % 2) AS even_cycle_meets_pair, 1 - (m % 2) AS predicted_cm FROM texts")
def a06(spark, sf):
    path = new_path(spark, "predictions")
    m = g6.num_edges(F.col("graph6"))
    text.write_predictions(graphs(spark, sf).select("*", m.alias("m"), (m % 2).alias("even_cycle_meets_pair"), (1 - m % 2).alias("predicted_cm")), path)
    return text.read_predictions(spark, path)


@query("a07_write_corpus", f"WITH {TEXTS} SELECT g AS graph_number, graph6, m, 9 AS n FROM texts")
def a07(spark, sf):
    path = new_path(spark, "corpus")
    rows = graphs(spark, sf).withColumn("m", g6.num_edges(F.col("graph6"))).withColumn("n", g6.g6_n(F.col("graph6")))
    text.write_corpus({"graphs": rows}, path)
    return spark.read.parquet(f"{path}/graphs")


@query(
    "a08_solver_input",
    f"""WITH {TEXTS}, e AS (SELECT g, string_agg('{{' || (i + 1) || ',' || (j + 1) || '}}', ', ' ORDER BY j, i) AS e FROM edges GROUP BY g)
    SELECT '{{' || g || ', "' || replace(replace(graph6, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '", {{' || e || '}}}}' AS value FROM texts JOIN e USING (g)""",
)
def a08(spark, sf):
    return text.solver_input(graphs(spark, sf))


#: Columns of whole numbers of every input table: a row's line has them, and lines are ordered by them.
INPUTS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"],
}

LINES = "l AS (" + " UNION ALL ".join(f"SELECT {k} AS file_order, '{name}' AS name, row_number() OVER (ORDER BY {', '.join(c)}) - 1 AS k, concat_ws('|', {', '.join(c)}) AS line FROM {name}" for k, (name, c) in enumerate(INPUTS.items())) + ")"
#: Up to 4096 * 4096 lines in a file.
TREE = LINES + """, b AS (SELECT file_order, name, k // 4096 AS block, count(*) AS lines, sha256(string_agg(sha256(line), '' ORDER BY k)) AS sha256 FROM l GROUP BY 1, 2, 3),
r AS (SELECT file_order, name, sum(lines)::BIGINT AS lines, CASE WHEN count(*) = 1 THEN max(sha256) ELSE sha256(string_agg(sha256, '' ORDER BY block)) END AS sha256 FROM b GROUP BY 1, 2)"""


def _inputs(spark, sf, changed=None):
    """The rows of every input table as lines of text, in order, one folder each."""
    root = new_path(spark, "inputs")
    for name, columns in INPUTS.items():
        line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
        rows = table(spark, sf, name).orderBy(*columns).select((line if changed is None else F.when(changed(F.col(columns[0])), F.concat(line, F.lit("|changed"))).otherwise(line)).alias("value"))
        rows.write.text(f"{root}/{name}")
    return [f"{root}/{name}" for name in INPUTS]


@query("a09_input_manifest", f"WITH {TREE} SELECT file_order, name, lines, sha256, sha256((SELECT string_agg(name || ':' || sha256, chr(10) ORDER BY file_order) FROM r)) AS digest FROM r")
def a09(spark, sf):
    """The digest of each input's blocks, and one over all of them."""
    roots = written(text.manifest_files(text.manifest_blocks(spark, _inputs(spark, sf))), "manifest-files")  # a row for each file
    return roots.select("file_order", F.element_at(F.split("file", "/"), -1).alias("name"), "lines", "sha256").crossJoin(F.broadcast(text.manifest_digest(roots)))


@query("a09_changed_blocks", f"WITH {LINES} SELECT DISTINCT file_order, 0 AS level, k // 4096 AS block FROM l WHERE split_part(line, '|', 1)::BIGINT % 1500 = 7")
def a09_changed(spark, sf):
    """Which blocks of lines are stale after some rows of the inputs changed."""
    old, new = (text.manifest_tree(spark, _inputs(spark, sf, changed)) for changed in (None, lambda key: key % 1500 == 7))
    return text.changed_blocks(old, new).filter("level = 0")


@query("a10_export_view", f"WITH {TEXTS} SELECT g AS graph_number, m FROM texts WHERE m >= 12")
def a10(spark, sf):
    path = new_path(spark, "view")
    graphs(spark, sf).withColumn("m", g6.num_edges(F.col("graph6"))).filter("m >= 12").select("graph_number", "m").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("graph_number long, m int").csv(path)


@query("a11_encode_graph6", f"WITH {TEXTS} SELECT g AS graph_number, graph6 FROM texts")
def a11(spark, sf):
    return graphs(spark, sf)


@query(
    "b01_decode_graph6",
    f"""WITH {ADJ} SELECT t.g AS graph_number, 9 AS n, (SELECT string_agg((i + 1) || '-' || (j + 1), ',' ORDER BY j, i) FROM edges e WHERE e.g = t.g) AS edges,
    (SELECT string_agg(a::VARCHAR, ',' ORDER BY v) FROM adj WHERE adj.g = t.g) AS adj FROM texts t""",
)
def b01(spark, sf):
    rows = ops.decoded(graphs(spark, sf))
    return rows.select(
        "graph_number", "n", F.concat_ws(",", F.transform("edges", lambda e: F.format_string("%d-%d", e["i"], e["j"]))).alias("edges"), F.concat_ws(",", F.transform("adj", lambda a: a.cast("string"))).alias("adj")
    )


@query(
    "b02_edges_triangles",
    f"""WITH {TEXTS}, t AS (SELECT x.g, count(*) AS c FROM edges x JOIN edges y ON y.g = x.g AND y.i = x.j JOIN edges z ON z.g = x.g AND z.i = x.i AND z.j = y.j GROUP BY x.g)
    SELECT g AS graph_number, m, coalesce(c, 0) AS n_triangles FROM texts LEFT JOIN t USING (g)""",
)
def b02(spark, sf):
    e = edges(spark, sf)
    return g6.triangle_count(e).join(e.groupBy("graph_number").agg(F.count(F.lit(1)).alias("m")), "graph_number")


@query("b03_band_filter", f"WITH {BAND} SELECT g AS graph_number, graph6 FROM band")
def b03(spark, sf):
    return band(spark, sf)


@query(
    "b04_occ_witness",
    f"""WITH RECURSIVE {CYCLES}, nb AS (SELECT DISTINCT s.g, s.s FROM sub s JOIN oddc o ON o.g = s.g AND o.s & s.s = o.s),
    w AS (SELECT s.g, s.s, 511 - (s.s | s.near) AS t, row_number() OVER (PARTITION BY s.g ORDER BY s.pc, s.s) AS rn FROM sub s JOIN nb USING (g, s) JOIN nb o ON o.g = s.g AND o.s = 511 - (s.s | s.near))
    SELECT b.g AS graph_number, (w.s IS NOT NULL)::INT AS fails_occ, w.s AS occ_s, w.t AS occ_t FROM band b LEFT JOIN w ON w.g = b.g AND w.rn = 1""",
)
def b04(spark, sf):
    return ops.with_occ(band(spark, sf)).select("graph_number", "fails_occ", "occ_s", "occ_t")


@query("b12_take_share", f"WITH {EDGES}, p AS (SELECT g, row_number() OVER (ORDER BY g) AS p FROM (SELECT DISTINCT g FROM edges)) SELECT g AS graph_number, p AS position FROM p WHERE (p - 1) % 5 IN (2, 4)")
def b12(spark, sf):
    return ops.take_share(ops.numbered(edges(spark, sf).select("graph_number").distinct(), "graph_number"), "2,4/5")


@query(
    "b13_batches",
    f"WITH {EDGES}, p AS (SELECT g, row_number() OVER (ORDER BY g) AS p FROM (SELECT DISTINCT g FROM edges)) SELECT (p - 1) // 100 AS batch, count(*) AS n, min(g) AS first_graph, max(g) AS last_graph FROM p GROUP BY 1",
)
def b13(spark, sf):
    rows = ops.assign_batches(ops.numbered(edges(spark, sf).select("graph_number").distinct(), "graph_number"), 100)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("graph_number").alias("first_graph"), F.max("graph_number").alias("last_graph"))


@query("b14_number_graphs", f"WITH {BAND} SELECT g AS line_no, graph6, row_number() OVER (ORDER BY g) AS graph_number FROM band")
def b14(spark, sf):
    return ops.number_graphs(graphs(spark, sf).withColumnRenamed("graph_number", "line_no"))


@query(
    "b15_keep_numbered",
    f"WITH RECURSIVE {CYCLES}{FAILING}, p AS (SELECT g, graph6, row_number() OVER (ORDER BY g) AS graph_number FROM band) SELECT g AS line_no, graph6, graph_number FROM p WHERE graph6 IN (SELECT graph6 FROM band JOIN failing USING (g))",
)
def b15(spark, sf):
    own = graphs(spark, sf).withColumnRenamed("graph_number", "line_no")
    return ops.keep_numbered(ops.number_graphs(own), ops.failing_filter(own))


@query(
    "b09_pending_work",
    f"WITH {EDGES}, ev AS (SELECT user_id * 25 + event_id % 25 AS g FROM events) SELECT DISTINCT g AS graph_number FROM edges WHERE g NOT IN (SELECT g FROM ev) ORDER BY 1 LIMIT 200",
)
def b09(spark, sf):
    return ops.pending(edges(spark, sf).select("graph_number").distinct(), runs(spark, sf).select("graph_number").distinct(), limit=200)


@query(
    "flagship",
    f"""WITH RECURSIVE {CYCLES}{FAILING} SELECT b.m, count(*) AS graphs, count(f.g) AS failing, count(*) - count(f.g) AS satisfying
    FROM band b LEFT JOIN failing f USING (g) GROUP BY b.m""",
)
def flagship(spark, sf):
    """Corpus, odd cycle condition, separated pairs, and a contingency table by the number of edges."""
    rows = ops.with_features(band(spark, sf), ["m", "fails_occ", "sep_pairs"])
    return rows.groupBy("m").agg(F.count(F.lit(1)).alias("graphs"), F.count_if((F.col("fails_occ") == 1) & (F.col("sep_pairs") > 0)).alias("failing"), F.count_if(F.col("sep_pairs") == 0).alias("satisfying"))

