import hashlib

import pytest
from pyspark.sql import functions as F

from graphmill.functions import parsing
from graphmill.operators import hilbert, order, runs
from graphmill.sources import text
from graphmill.streaming import log
from graphmill.scratch import new_path


def test_parsers(spark):
    cases = {
        "(1+5*T)/((1-T)^8)": ([1, 5], 8), "(1+2*T+2*T^2+2*T^3+2*T^4-T^5)/((1-T)^8)": ([1, 2, 2, 2, 2, -1], 8), "(1+T+T^2)/((1-T)^8)": ([1, 1, 1], 8),
        "(1+3*T+4*T^2+4*T^3+2*T^4-2*T^5)/((1-T)^8)": ([1, 3, 4, 4, 2, -2], 8), "( 1 + T^3 )/((1-T)^2)": ([1, 0, 0, 1], 2), "(-T)/((1-T)^1)": ([0, -1], 1), "nonsense": (None, None), "(1+x)/((1-T)^2)": (None, 2),
    }
    df = spark.createDataFrame([(s,) for s in cases] + [(None,)], "s string")
    for r in df.select("s", parsing.h_vector(F.col("s")).alias("h"), parsing.hilbert_dim(F.col("s")).alias("d")).collect():
        assert (r["h"], r["d"]) == cases.get(r["s"], (None, None))
    with pytest.raises(Exception, match="bad Hilbert series"):
        df.filter("s = 'nonsense'").select(parsing.h_vector(F.col("s"), strict=True)).collect()
    ideal = "ideal(e_4*e_8-e_3*e_10,e_1*e_5*e_7*e_9^2-e_2*e_6^2*e_8*e_10)"
    df = spark.createDataFrame([(ideal,), ("e_1*e_3*e_5^2*e_8^2-e_2^2*e_4*e_6*e_7*e_9",)], "s string")
    out = df.select(F.transform(parsing.ideal_generators(F.col("s")), parsing.binomial_degree).alias("d"), parsing.binomial_degree(F.col("s")).alias("one")).collect()
    assert out[0]["d"] == [2, 5] and out[1]["d"] == [] and out[1]["one"] == 6
    h = spark.createDataFrame([([1, 3, -1, 0, 1],), ([0],)], "h array<int>").select(parsing.h_text(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in h] == ["1+3*T-T^2+T^4", "0"]


LOG = [(5, 1, "timeout", None), (5, 2, "done", None), (5, 3, "error", None), (6, 4, "timeout", None), (6, 5, "timeout", "depth_ZZp"), (8, 6, "error", None)]


@pytest.mark.parametrize("parts", [1, 5])
def test_reconciling(spark, parts):
    df = spark.createDataFrame(LOG, "graph_number long, line_no long, status string, stage string").repartition(parts)
    latest = {r["graph_number"]: (r["status"], r["stage"]) for r in runs.latest_runs(df).collect()}
    assert latest == {5: ("done", None), 6: ("timeout", "depth_ZZp"), 8: ("error", None)}
    assert runs.load_done(df, retry=True).count() == 0 and runs.load_done(df, retry=False).count() == 3
    assert {r["graph_number"] for r in runs.failed_items(df).collect()} == {6, 8}


def test_verdicts(spark):
    rows = [(9, None, "negative_h", None, 0, "negative_h"), (9, 9, None, None, 1, "depth_ZZp_eq_n"), (9, 8, "depth_ZZp", None, None, "screen_ZZp"), (9, 8, None, 9, 1, "depth_QQ"), (9, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, z int, by string, d int, cm int, want string")
    for r in df.select("cm", "want", runs.verdict(F.col("n"), F.col("z"), F.col("by"), F.col("d")).alias("v")).collect():
        assert (r["v"]["is_cm"], r["v"]["decided_by"]) == (r["cm"], r["want"])


def test_merge_upsert_and_unknowns(spark):
    lines = spark.createDataFrame([(1, 0, 1, False), (1, 1, 2, True), (1, 2, 3, True), (2, 0, 4, False), (2, 1, 5, False)], "graph_number long, file_order int, line_no long, complete boolean")
    assert {(r["graph_number"], r["line_no"]) for r in runs.merge_results(lines).collect()} == {(1, 2), (2, 4)}
    wanted = spark.createDataFrame([(1,), (3,)], "graph_number long")
    assert tuple(runs.coverage(wanted, runs.merge_results(lines)).first()) == (2, 1, 1, 1)
    a, b = spark.createDataFrame([("g", 4, "old")], "graph6 string, number long, source string"), spark.createDataFrame([("g", None, "new")], "graph6 string, number long, source string")
    assert runs.upsert([a, b], coalesced="number").first().asDict() == {"graph6": "g", "number": 4, "source": "new"}
    r = runs.derive_results(spark.createDataFrame([(9, 10, None, "(1+T+T^2)/((1-T)^9)", None, 1)], "n int, m int, depth int, hilbert_series string, toric_ideal string, gens_minimal int")).first()
    assert (r["is_cm"], r["is_gorenstein"], r["is_ci"], r["h_symmetric"]) == (None, None, None, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "log").write_text('{"graph_number": 1, "status": "done", "h_vector": [1, 2]}\n{"graph_number": 2, "status": "tim')
    out = text.run_records(text.ordered_lines(spark, str(tmp_path / "log"))).collect()
    assert [(r["graph_number"], r["line_no"], r["h_vector"]) for r in out] == [(1, 0, [1, 2])]
    (tmp_path / "dump").write_text("noise: 1\n====\nGraphNumber: 3\nDepth: 1\nDepth: 2 \n====\nGraphNumber: 4\nIdeal: a: b\n")
    want = [{"GraphNumber": "3", "Depth": "2"}, {"GraphNumber": "4", "Ideal": "a: b"}]
    assert sorted((r["kv"] for r in text.read_blocks(spark, str(tmp_path / "dump")).collect()), key=lambda x: x["GraphNumber"]) == want
    assert sorted((r["kv"] for r in text.blocks(text.ordered_lines(spark, str(tmp_path / "dump"))).collect()), key=lambda x: x["GraphNumber"]) == want
    (tmp_path / "list").write_text("50 FCQrO\n\n51 G`\\x\n")
    assert [tuple(r) for r in text.read_graph_list(spark, str(tmp_path / "list")).collect()] == [(50, "FCQrO"), (51, "G`\\x")]
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_bytes(b"a\r\nb\n")
    two.write_bytes(b"a\nb\n")
    digests = [r["sha256"] for r in text.input_manifest(spark, [str(one), str(two)]).orderBy("file_order").collect()]
    assert digests[0] == digests[1] == hashlib.sha256(b"a\nb\n").hexdigest()


def test_lines_and_their_digests_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "MANIFEST_LINES", 4)
    lines = [[f"{name} {k * 7919 % 1000}" for k in range(n)] for name, n in (("x", 70), ("y", 3))]
    spark.createDataFrame([(k, v) for k, v in enumerate(lines[0])], "k int, value string").repartitionByRange(5, "k").sortWithinPartitions("k").select("value").write.text(str(tmp_path / "x"))
    (tmp_path / "y").write_bytes("\r\n".join([*lines[1], ""]).encode())
    paths = [str(tmp_path / "x"), str(tmp_path / "y")]
    out = sorted((r["file_order"], r["line_no"], r["value"].strip()) for r in text.ordered_lines(spark, paths).collect())
    assert out == [(f, k, v) for f, own in enumerate(lines) for k, v in enumerate(own)]
    tree = text.manifest_tree(spark, paths)
    found = {(r["file_order"], r["level"], r["block"]): r["sha256"] for r in tree.collect()}
    want, roots = {}, {}
    for f, own in enumerate(lines):
        level, k = [hashlib.sha256(v.encode()).hexdigest() for v in own], 0
        while k == 0 or len(level) > 1:
            level = [hashlib.sha256("".join(level[at : at + 4]).encode()).hexdigest() for at in range(0, len(level), 4)]
            want |= {(f, k, at): d for at, d in enumerate(level)}
            k += 1
        roots[f] = (len(own), level[0])
    assert found == want
    assert {r["file_order"]: (r["lines"], r["sha256"]) for r in text.manifest_roots(tree).collect()} == roots
    # one changed line of the second file and one more line of the first: their blocks and what is above them
    (tmp_path / "y").write_bytes("\r\n".join([lines[1][0], "other", lines[1][2], ""]).encode())
    (tmp_path / "x" / "part-99999.txt").write_text("more\n")
    stale = {(r["file_order"], r["level"], r["block"]) for r in text.changed_blocks(tree, text.manifest_tree(spark, paths)).collect()}
    assert stale == {(1, 0, 0), (0, 0, 17), (0, 1, 4), (0, 2, 1), (0, 3, 0)}
    assert text.changed_blocks(tree, tree).count() == 0


def test_bands_of_large_graphs(spark):
    from graphmill.functions.graph6 import g6_encode
    from graphmill.operators import corpus

    # a cycle of 20 vertices with a chord that closes a triangle, the same cut in two, and an even cycle with an even chord
    ring = [(k, (k + 1) % 20) for k in range(20)]
    graphs = {1: [*ring, (0, 2)], 2: [*[(k, (k + 1) % 10) for k in range(10)], *[(10 + k, 10 + (k + 1) % 10) for k in range(10)], (0, 2)], 3: [*ring, (0, 3)]}
    rows = spark.createDataFrame([(g, min(e), max(e)) for g, es in graphs.items() for e in es], "graph_number long, i long, j long")
    assert [r["graph_number"] for r in corpus.band_filter(g6_encode(rows, 20)).collect()] == [1]
    with pytest.raises(Exception, match="more than 12 vertices"):
        corpus.failing_filter(g6_encode(rows, 20)).collect()


def test_positions_of_sparse_orders(spark):
    from graphmill.operators import corpus

    ids = [(k * k * 10**9 + k,) for k in range(3000)]
    out = corpus.numbered(spark.createDataFrame(ids[::-1], "id long"), "id", ranges=16).collect()
    assert {r["id"]: r["position"] for r in out} == {v: k + 1 for k, (v,) in enumerate(ids)}
    assert corpus.numbered(spark.createDataFrame([], "id long"), "id").count() == 0


def test_h_vectors_of_seven_vertex_graphs(spark):
    from graphmill.functions.graph6 import g6_edges

    known = {"FCQrO": [1, 1, 1, 1, 1], "FQhV?": [1, 2, 2, 2, 1], "FQhV_": [1, 3, 4, 3, 1], "FQhVO": [1, 3, 4, 4, 1], "FQhVo": [1, 4, 7, 5, 1], "FQhVw": [1, 5, 11, 6, 1]}
    df = spark.createDataFrame([(g,) for g in known], "graph_number string")
    edges = df.select("graph_number", F.explode(g6_edges(F.col("graph_number"))).alias("e")).select("graph_number", (F.col("e.i") - 1).alias("i"), (F.col("e.j") - 1).alias("j"))
    for r in hilbert.h_from_hilbert(hilbert.hilbert_function(edges, 7), 7).collect():
        assert r["h"] == known[r["graph_number"]] + [0, 0, 0] and not r["truncated"]


def test_cumulative_is_free_of_partitions(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), (F.col("id") * 37 % 501).alias("k"), F.col("id").alias("v"))
    want, total = {}, 0
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        total += r["v"]
        want[r["k"]] = total
    out = order.cumulative(df.repartition(6), ["g"], F.floor(F.col("k") / 50), ["k"], {"c": "v"}).collect()
    assert {r["k"]: r["c"] for r in out} == want


def test_stream_state_does_not_depend_on_arrival(spark):
    df = spark.createDataFrame(LOG, "graph_number long, line_no long, status string, stage string")
    for rows in (df, df.orderBy(F.desc("line_no"))):
        path = new_path(spark, "test-stream")
        for k in range(2):
            rows.filter(F.col("line_no") % 2 == k).coalesce(1).write.mode("append").json(path)
        store = log.latest_runs(spark)
        stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)  # noqa: E731, B023
        checkpoint = new_path(spark, "test-checkpoint")
        out = log.stream_latest(stream(), store, checkpoint)
        assert {r["graph_number"]: r["status"] for r in out.collect()} == {5: "done", 6: "timeout", 8: "error"}
        spark.createDataFrame([(8, 1, "done", None), (5, 99, "error", None)], df.schema).coalesce(1).write.mode("append").json(path)
        out = log.stream_latest(stream(), store, checkpoint)  # goes on from the checkpoint
        assert {r["graph_number"]: r["status"] for r in out.collect()} == {5: "done", 6: "timeout", 8: "done"}


def test_shares_are_a_partition(spark):
    from graphmill.operators import corpus

    rows = spark.range(1, 31).withColumnRenamed("id", "position")
    parts = [[r["position"] for r in corpus.take_share(rows, share).collect()] for share in ("0/3", "1,2/3")]
    assert parts[0] == list(range(1, 31, 3)) and sorted(parts[0] + parts[1]) == list(range(1, 31))


def test_status_labels_and_counts(spark):
    from graphmill.operators import relate

    rows = [(0, None, None, "satisfies OCC"), (1, "screen_ZZp", None, "fails OCC · screened not CM (unproven)"), (1, None, None, "fails OCC · not computed yet"), (1, "depth_QQ", 1, "fails OCC · CM"), (1, "negative_h", 0, "fails OCC · not CM")]
    df = spark.createDataFrame(rows, "fails int, by string, cm int, want string")
    assert df.filter(relate.status(F.col("fails"), F.col("by"), F.col("cm")) != F.col("want")).count() == 0
    loaded = spark.createDataFrame([(True, 1), (True, None), (False, None), (False, 0)], "has_result boolean, is_cm int")
    assert tuple(runs.load_counts(loaded).first()) == (1, 3)
    with pytest.raises(ValueError, match="two ranges"):
        relate.apply_filters(df, {"ranges": {"a": (0, 1), "b": (0, 1), "c": (0, 1)}})


def test_blocks_become_results(spark):
    kv = {"GraphNumber": "50", "Graph6": "FCQrO", "NumEdges": "8", "ToricIdeal": "ideal(e_2*e_3*e_5*e_7^2-e_1*e_4^2*e_6*e_8)", "Depth": "7", "ReducedHilbertSeries": "(1+T+T^2+T^3+T^4)/((1-T)^7)", "SecondsKer": ".0157908", "SecondsDepth": ".00783634", "SecondsHilbert": ".000859727"}
    one = runs.derive_results(runs.results_from_blocks(spark.createDataFrame([(kv,)], "kv map<string,string>")).withColumn("n", F.lit(7))).first()
    assert (one["graph_number"], one["graph6"], one["is_cm"], one["h_vector"], one["is_gorenstein"], one["is_ci"], one["gen_degrees"], one["seconds_ker"]) == (50, "FCQrO", 1, [1] * 5, 1, 1, [5], 0.0157908)
    bad = spark.createDataFrame([(7, 8, None, "(1+x)/((1-T)^7)", None, 1)], "n int, m int, depth int, hilbert_series string, toric_ideal string, gens_minimal int")
    with pytest.raises(Exception, match="bad Hilbert series"):
        runs.derive_results(bad).collect()


def test_numbering_rules_and_stage_costs(spark):
    from graphmill.operators import relate

    rows = spark.createDataFrame([(8, 1), (8, 2), (8, 4), (8, 4), (9, 1), (9, 2)], "n int, number long")
    assert {r["rule"]: r["violations"] for r in relate.numbering_rules(rows, ["n"], "number").collect()} == {"numbers_have_no_gap": 1, "n_and_number_are_unique": 1}
    blocks = spark.createDataFrame([(1, 0.5, 0.25, 2.0), (2, None, 0.25, 1.0), (3, 1.0, 1.0, None)], "graph_number long, seconds_ker double, seconds_hilbert double, seconds_depth double")
    again = spark.createDataFrame([(1, 9, 4.0), (1, 9, 3.0), (7, 9, 1.0)], "graph_number long, depth int, seconds double")
    out = {r["graph_number"]: (r["seconds_again"], r["cost"], r["cpu_total"]) for r in runs.stage_costs(blocks, again).collect()}
    assert out == {1: (4.0, 4.75, 2.75), 2: (0.0, 0.25, 1.25), 3: (0.0, 2.0, 2.0)}
