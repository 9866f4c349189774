import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.functions import graph6, kernel
from graphmill.operators import corpus, relate

TTP = (7, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 6), (6, 3)])
TTE = (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)])
TRI_PENT = (9, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (5, 6), (6, 7), (7, 3), (2, 8), (8, 3)])
TWO_PATHS = (8, [*TTP[1], (1, 7), (7, 4)])
PETERSEN = (10, [*[(k, (k + 1) % 5) for k in range(5)], *[(k, k + 5) for k in range(5)], *[(5 + k, 5 + (k + 2) % 5) for k in range(5)]])
K4 = (4, list(itertools.combinations(range(4), 2)))


def text(graph):
    n, edges = graph
    bits = [0] * (-(-n * (n - 1) // 2 // 6) * 6)
    for a, b in edges:
        i, j = sorted((a, b))
        bits[j * (j - 1) // 2 + i] = 1
    return chr(63 + n) + "".join(chr(63 + int("".join(map(str, bits[k : k + 6])), 2)) for k in range(0, len(bits), 6))


def features(graph, columns=None):
    columns = columns or kernel.COLUMNS
    out = kernel.compute(kernel.decode([text(graph)]), columns)
    return {c: None if isinstance(v[0], float) and np.isnan(v[0]) else v[0] for c, v in out.items()}


def test_smallest_failing_graph():
    f = features(TTP)
    known = {
        "n": 7, "m": 8, "m_minus_n": 1, "deg_count_2": 5, "deg_count_3": 2, "n_threads": 3, "thread_max_len": 3, "n_triangles": 2, "cyc_len_3": 2, "n_even_cycles": 0, "girth": 3, "odd_girth": 3, "n_cut_vertices": 3,
        "n_bridges": 2, "n_blocks": 4, "n_nonbipartite_blocks": 2, "diameter": 4, "node_connectivity": 1, "odd_cycle_transversal": 2, "edge_frustration": 2, "independence_number": 3, "matching_number": 3,
        "chromatic_number": 3, "treewidth": 2, "aut_group_size": 8, "sep_pairs": 1, "sep_pairs_3_3": 1, "normalization_gap": 1, "sep_dist_min": 2, "sep_closest_geodesics": 1, "sep_linkage_max": 1,
        "sep_same_block_pairs": 0, "sep_walk_degree_max": 5, "occ_s": 0b111, "occ_t": 0b111000,
    }
    assert {k: f[k] for k in known} == known
    assert np.isnan(kernel.compute(kernel.decode([text(TTP)]), ["even_girth"])["even_girth"][0]) and f["signless_lap_min"] > 1e-9


def test_named_graphs():
    assert features(TTE)["fails_occ"] == 0 and features(TRI_PENT)["fails_occ"] == 1
    for n in (4, 6):
        cycle = features((n, [(k, (k + 1) % n) for k in range(n)]))
        assert cycle["is_nonbipartite"] == 0 and cycle["fails_occ"] == 0
    f = features(TWO_PATHS)
    assert (f["even_cycle_meets_pair"], f["even_meeting_len_min"]) == (1, 6)
    f = features(PETERSEN)
    assert [f[c] for c in ("girth", "aut_group_size", "chromatic_number", "treewidth", "independence_number", "n_spanning_trees")] == [5, 120, 3, 4, 4, 2000]
    f = features(K4)
    assert [f[c] for c in ("aut_group_size", "treewidth", "n_spanning_trees", "cyc_len_4")] == [24, 3, 16, 3]


def slow(n, edges):
    """The definitions, by search over orders and subsets."""
    adj = [{b if a == v else a for a, b in edges if v in (a, b)} for v in range(n)]
    cycles = {}
    for size in range(3, n + 1):
        for own in itertools.combinations(range(n), size):
            for rest in itertools.permutations(own[1:]):
                if rest[0] < rest[-1]:
                    order = (own[0], *rest)
                    if all(order[(k + 1) % size] in adj[order[k]] for k in range(size)):
                        cycles[own] = cycles.get(own, 0) + 1
    chordless = [c for c in cycles if sum(a in c and b in c for a, b in edges) == len(c)]
    odd = [set(c) for c in chordless if len(c) % 2]
    pairs = [(a, b) for a, b in itertools.combinations(odd, 2) if not a & b and not any((x in a and y in b) or (x in b and y in a) for x, y in edges)]
    subsets = [set(c) for k in range(n + 1) for c in itertools.combinations(range(n), k)]
    cut = max(sum((a in s) != (b in s) for a, b in edges) for s in subsets)
    independent = max(len(s) for s in subsets if not any(a in s and b in s for a, b in edges))
    colours = next(k for k in range(1, n + 1) if any(all(c[a] != c[b] for a, b in edges) for c in itertools.product(range(k), repeat=n)))
    maps = sum(all((p[b] in adj[p[a]]) for a, b in edges) for p in itertools.permutations(range(n)))
    width = min(_width(adj, order) for order in itertools.permutations(range(n)))
    matching = max(k for k in range(n // 2 + 1) if any(len({v for e in m for v in e}) == 2 * k for m in itertools.combinations(edges, k)))
    even = sum(c for s, c in cycles.items() if len(s) % 2 == 0 and any(set(s) & a and set(s) & b for a, b in pairs))
    return {
        "n_odd_cycles": sum(c for s, c in cycles.items() if len(s) % 2), "n_even_cycles": sum(c for s, c in cycles.items() if len(s) % 2 == 0), "n_chordless_odd_cycles": len(odd), "sep_pairs": len(pairs),
        "fails_occ": int(bool(pairs)), "edge_frustration": len(edges) - cut, "independence_number": independent, "chromatic_number": colours, "aut_group_size": maps, "treewidth": width, "matching_number": matching,
        "even_cycles_meeting_pair": even, "normalization_gap": len({frozenset(a | b) for a, b in pairs}),
    }


def _width(adj, order):
    adj, best = [set(a) for a in adj], 0
    for v in order:
        near = adj[v]
        best = max(best, len(near))
        for a in near:
            adj[a] |= near - {a}
            adj[a].discard(v)
        adj[v] = set()
    return best


@pytest.mark.parametrize("seed", range(8))
def test_kernel_equals_the_definitions(seed):
    rnd = random.Random(seed)
    n = rnd.choice([5, 6, 6])
    edges = [e for e in itertools.combinations(range(n), 2) if rnd.random() < rnd.choice([0.35, 0.5, 0.7])] or [(0, 1)]
    want = slow(n, edges)
    got = features((n, edges), list(want))
    assert {k: int(v) for k, v in got.items()} == want


def test_batches_do_not_mix_graphs():
    rnd = random.Random(2)
    graphs = [(7, [e for e in itertools.combinations(range(7), 2) if rnd.random() < 0.4]) for _ in range(40)]
    columns = [c for c in kernel.COLUMNS if c not in kernel.LISTS]
    together = kernel.compute(kernel.decode([text(g) for g in graphs]), columns)
    for k, g in enumerate(graphs):
        alone = kernel.compute(kernel.decode([text(g)]), columns)
        for c in columns:
            assert np.allclose(float(together[c][k]), float(alone[c][0]), equal_nan=True), c


def test_text_columns(spark):
    rows = [(k, text(g), len(g[1]), g[0]) for k, g in enumerate([TTP, TTE, PETERSEN, K4])] + [(9, "GCOe`W", 9, 8)]
    df = spark.createDataFrame(rows, "graph_number long, graph6 string, m int, size int")
    g = F.col("graph6")
    out = df.select("graph_number", "m", "size", graph6.g6_n(g).alias("n"), graph6.num_edges(g).alias("edges"), graph6.g6_edges(g).alias("list"), graph6.g6_adj(g).alias("adj")).collect()
    for r in out:
        assert r["n"] == r["size"] and r["edges"] == r["m"] == len(r["list"]) == sum(a.bit_count() for a in r["adj"]) // 2
    assert tuple(next(r for r in out if r["graph_number"] == 9)["list"][0]) == (1, 4)
    with pytest.raises(Exception, match="more than 62"):
        spark.createDataFrame([(chr(63 + 63),)], "g string").select(graph6.g6_n(F.col("g"))).collect()
    back = df.filter("size = 7").select("graph_number", F.explode(graph6.g6_edges(g)).alias("e")).select("graph_number", (F.col("e.i") - 1).alias("i"), (F.col("e.j") - 1).alias("j"))
    assert graph6.g6_encode(back, 7).first()["graph6"] == text(TTP)


def test_features_keep_rows_and_give_nulls(spark):
    df = spark.createDataFrame([(1, text(TTP)), (2, None), (3, "~"), (4, text(PETERSEN))], "id long, graph6 string")
    out = {r["id"]: r for r in corpus.with_features(df, ["m", "even_girth", "adj_spectrum"]).collect()}
    assert (out[1]["m"], out[1]["even_girth"], out[2]["m"], out[3]["m"], out[4]["m"]) == (8, None, None, None, 15) and len(out[4]["adj_spectrum"]) == 10


def test_relational_pairs_equal_the_kernel(spark):
    rnd = random.Random(1)
    rows = [(k, text((9, [e for e in itertools.combinations(range(9), 2) if rnd.random() < 0.28]))) for k in range(60)] + [(99, text(TTP))]
    df = spark.createDataFrame(rows, "graph_number long, graph6 string")
    pairs = relate.sep_pairs(relate.odd_cycles(df), "graph_number").groupBy("graph_number").count()
    joined = corpus.with_features(df, ["sep_pairs"]).join(pairs, "graph_number", "left").fillna(0)
    assert joined.filter("sep_pairs <> count").count() == 0 and joined.filter("sep_pairs > 0").count() > 0


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k"))
    want = {k: p for p, k in enumerate(sorted(r["k"] for r in df.collect()), 1)}
    for parts in (1, 7):
        assert {r["k"]: r["position"] for r in corpus.numbered(df.repartition(parts), "k", ranges=8).collect()} == want
