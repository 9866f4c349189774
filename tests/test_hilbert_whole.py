"""Whole numerators, against those that Macaulay2 gave (n = 7 and n = 9)."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphmill.functions.graph6 import g6_edges
from graphmill.operators import corpus, hilbert

#: Graph number: edges (from 1) and h-vector; the negative coefficient is the last.
KNOWN = {
    7161: ("15 18 28 48 58 26 69 37 39 49 79", [1, 2, 3, 4, 3, 1, -1]),
    7758: ("15 18 58 26 29 69 37 47 78 39 49", [1, 2, 2, 2, 2, 2, -1]),
    7921: ("15 18 58 26 29 69 37 47 38 78 39 49", [1, 3, 5, 6, 4, 1, -1]),
}


def test_negative_coefficients_at_the_top_are_found(spark):
    edges = spark.createDataFrame([(g, int(e[0]) - 1, int(e[1]) - 1) for g, (text, _) in KNOWN.items() for e in text.split()], "graph_number long, i long, j long")
    out = {r["graph_number"]: r for r in hilbert.negative_h_screen(hilbert.h_from_hilbert(hilbert.hilbert_by_graph(edges, 9), 9)).collect()}
    for g, (_, h) in KNOWN.items():
        assert out[g]["h"] == h + [0] * (10 - len(h)) and out[g]["truncated"] is False and out[g]["is_cm"] == 0


#: h-vectors of the six 7-vertex graphs that fail the condition.
SEVEN = {"FCQrO": [1, 1, 1, 1, 1], "FQhV?": [1, 2, 2, 2, 1], "FQhV_": [1, 3, 4, 3, 1], "FQhVO": [1, 3, 4, 4, 1], "FQhVo": [1, 4, 7, 5, 1], "FQhVw": [1, 5, 11, 6, 1]}


def test_seven_vertices(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(SEVEN)], "graph_number long, graph6 string")
    e = rows.select("graph_number", F.explode(g6_edges(F.col("graph6"))).alias("e")).select("graph_number", (F.col("e.i") - 1).alias("i"), (F.col("e.j") - 1).alias("j"))
    for sizes in (hilbert.hilbert_by_graph(e, 7), hilbert.hilbert_function(e, 7)):
        out = {r["graph_number"]: r for r in hilbert.h_from_hilbert(sizes, 7).collect()}
        for k, h in enumerate(SEVEN.values()):
            assert out[k]["h"] == h + [0] * (8 - len(h)) and not out[k]["truncated"]
    with pytest.raises(Exception, match="more than 12 vertices"):
        hilbert.hilbert_by_graph(e.withColumn("j", F.col("j") + 12), 2).collect()


def test_normal_numerators_end_at_half_of_the_vertices(spark):
    rnd = random.Random(3)
    edges = [(k, i, j) for k in range(60) for i, j in itertools.combinations(range(6), 2) if rnd.random() < 0.6]
    df = spark.createDataFrame(edges, "graph_number long, i long, j long")
    from graphmill.functions.graph6 import g6_encode

    known = corpus.with_features(g6_encode(df, 6), ["fails_occ", "n_components", "is_nonbipartite"]).filter("fails_occ = 0 and n_components = 1 and is_nonbipartite = 1")
    own = df.join(known.select("graph_number"), "graph_number", "left_semi")
    out = hilbert.h_from_hilbert(hilbert.hilbert_by_graph(own, 6), 6).collect()
    assert len(out) > 20 and all(r["h"][4:] == [0, 0, 0] and min(r["h"]) >= 0 for r in out)


def plain_sizes(edges, last):
    steps = {tuple(int(v in e) for v in range(12)) for e in edges}
    front, sizes = {(0,) * 12}, [1]
    for _ in range(last):
        front = {tuple(a + b for a, b in zip(v, s)) for v in front for s in steps}
        sizes.append(len(front))
    return sizes


def test_eleven_and_twelve_vertices_over_tasks(spark):
    rnd = random.Random(9)
    ring = [(k, (k + 1) % 11) for k in range(11)] + [(0, 5), (2, 8), (3, 9), (1, 6)]
    more = sorted({tuple(sorted(rnd.sample(range(12), 2))) for _ in range(22)})
    graphs = {1: (ring, 5), 2: (more, 4), 3: ([(0, 1), (1, 2), (0, 2)], 7)}
    rows = [(g, min(e), max(e), last) for g, (es, last) in graphs.items() for e in es]
    df = spark.createDataFrame(rows, "graph_number long, i long, j long, last int").repartition(3)
    want = {(g, d): size for g, (es, last) in graphs.items() for d, size in enumerate(plain_sizes(es, last))}
    for found in (hilbert.hilbert_function(df, F.col("last"), slices=5), hilbert.hilbert_sizes(df, F.col("last"), in_task=2000), hilbert.hilbert_sizes(df, F.col("last"))):
        assert {(r["graph_number"], r["d"]): r["size"] for r in found.collect()} == want
    with pytest.raises(Exception, match="degrees would not fit"):
        hilbert.hilbert_sizes(df, 40).collect()


def test_a_graph_is_dealt_over_slices(spark):
    from graphmill.scratch import written

    ring = [(k, (k + 1) % 12) for k in range(12)] + [(0, 2), (3, 7), (5, 10)]
    df = spark.createDataFrame([(1, min(e), max(e)) for e in ring], "graph_number long, i long, j long")
    sizes = {r["d"]: r["size"] for r in hilbert.hilbert_function(df, 5, slices=16).collect()}
    assert sizes[5] > 5000
    # what a slice gets of the last degree's vectors is near its share
    front = spark.range(sizes[5]).select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("slice"))
    assert written(front, "slices").groupBy("slice").count().agg(F.max("count")).first()[0] < 2 * sizes[5] / 16
