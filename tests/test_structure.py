"""Features by expressions and joins against the kernel over subsets, on graphs that are not all connected."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphmill.functions.graph6 import g6_encode
from graphmill.operators import corpus, structure


@pytest.mark.parametrize(("n", "share"), [(6, 0.5), (8, 0.3), (7, 0.15)])
def test_native_features_equal_the_kernel(spark, n, share):
    rnd = random.Random(n)
    edges = [(k, i, j) for k in range(40) for i, j in itertools.combinations(range(n), 2) if rnd.random() < share]
    # two triangles, apart and with a path between them
    edges += [(100, i, j) for i, j in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5))] + ([(101, i, j) for i, j in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 6), (3, 6))] if n > 6 else [])
    graphs = g6_encode(spark.createDataFrame(edges, "graph_number long, i long, j long"), n)
    rows = structure.with_masks(graphs)
    odd = structure.cycles(rows, "graph_number", n, True).filter("len % 2 = 1")
    pairs = structure.separated(odd, "graph_number")
    whole, chordless = (structure.cycles(rows, "graph_number", n, c) for c in (False, True))
    found = [
        structure.sizes(rows), structure.degrees(rows), structure.triangles(rows), structure.components(rows), structure.threads(rows), structure.distances(rows), structure.pair_counts(rows, odd, pairs, "graph_number"),
        structure.meeting(rows, whole.filter("len % 2 = 0"), pairs, "graph_number"), structure.hamiltonian(rows, whole, "graph_number"),
        structure.cycle_counts(rows, whole, "graph_number", range(3, 11), False), structure.cycle_counts(rows, chordless, "graph_number", range(3, 11), True),
    ]
    own = {"graph_number", "graph6", "n", "adj", "deg"}
    for df in found:
        columns = [c for c in df.columns if c not in own]
        want = {r["graph_number"]: r for r in corpus.with_features(graphs, columns).collect()}
        got = df.collect()
        assert len(got) == len(want) and columns
        for r in got:
            for c in columns:
                x, y = r[c], want[r["graph_number"]][c]
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6)), (c, r["graph_number"], x, y)


def test_large_graphs_have_masks_too(spark):
    ring = [(1, k, k + 1) for k in range(39)] + [(1, 0, 39), (1, 0, 2)]
    rows = structure.with_masks(g6_encode(spark.createDataFrame(ring, "graph_number long, i long, j long"), 40))
    r = structure.distances(structure.components(structure.triangles(rows))).first()
    assert (r["n_components"], r["n_triangles"], r["diameter"]) == (1, 1, 20)
    assert structure.cycles(rows, "graph_number", 3, True).select(F.max("len")).first()[0] == 3
