"""What the review of round 4 found, on small inputs."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill import registry
from graphmill.functions import kernel, vectors
from graphmill.functions.graph6 import g6_encode
from graphmill.jobs import base, hilbert as jobs
from graphmill.operators import hilbert
from graphmill.sources import text


def test_a_files_digest_is_over_all_its_blocks(spark, tmp_path, monkeypatch):
    """a09_input_manifest: more than ``MANIFEST_LINES`` blocks made a third level, which the SQL doesn't have."""
    monkeypatch.setattr(text, "MANIFEST_LINES", 4)
    files = {"long": [f"line {k}" for k in range(70)], "short": ["a", "b"]}
    for name, own in files.items():
        (tmp_path / name).write_text("".join(f"{v}\n" for v in own))
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    blocks = [sha("".join(map(sha, files["long"][at : at + 4]))) for at in range(0, 70, 4)]
    out = text.manifest_files(text.manifest_blocks(spark, [str(tmp_path / name) for name in files])).orderBy("file_order").collect()
    assert [(r["lines"], r["sha256"]) for r in out] == [(70, sha("".join(blocks))), (2, sha(sha("a") + sha("b")))]


def some_graphs(n, many, edges, seed=5):
    rnd = random.Random(seed)
    pairs = list(itertools.combinations(range(n), 2))
    return [sorted(rnd.sample(pairs, rnd.randint(*edges))) for _ in range(many)]


def test_graphs_counted_together_and_alone(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 70)
    monkeypatch.setattr(vectors, "ROWS", 100)
    packed = [[(1 << 5 * i) + (1 << 5 * j) for i, j in g] for g in some_graphs(6, 150, (1, 15))]
    assert vectors.sizes(6, 5, packed) == [vectors._alone(5, g) for g in packed]


def test_forms_do_not_depend_on_numbers():
    rnd = random.Random(6)
    own = some_graphs(9, 60, (10, 20))
    own.append([(i, j) for i, j in itertools.combinations(range(9), 2) if (j - i) % 9 in (1, 8)])  # a ring: all colours alike

    def masks(g, order):
        adj = [0] * 9
        for i, j in g:
            adj[order[i]] |= 1 << order[j]
            adj[order[j]] |= 1 << order[i]
        return adj

    plain = np.array([masks(g, range(9)) for g in own])
    mixed = np.array([masks(g, rnd.sample(range(9), 9)) for g in own])
    forms = kernel.forms(plain)
    assert kernel.forms(mixed) == forms
    for c in ("m", "n_triangles", "aut_group_size", "fails_occ"):
        assert (kernel.compute(kernel.decode(forms), [c])[c] == kernel.compute(plain, [c])[c]).all()


def test_sizes_of_graphs_and_of_their_edges(spark):
    rows = [(k, i, j, 6 if k % 2 else 4) for k, g in enumerate(some_graphs(7, 40, (6, 12))) for i, j in [*g, (0, 6)]]
    edges = spark.createDataFrame(rows, "graph_number long, i long, j long, last int")
    last = F.when(F.col("graph_number") % 2 == 1, 6).otherwise(4)
    want = {}
    for r in hilbert.hilbert_by_graph(edges, F.col("last")).collect():
        want.setdefault(r["graph_number"], {})[r["d"]] = r["size"]
    for in_task in (hilbert.IN_TASK, 10):  # within tasks, and dealt by slices
        found = hilbert.hilbert_of_graphs(g6_encode(edges, 7), last, in_task=in_task).collect()
        assert {r["graph_number"]: dict(enumerate(r["sizes"])) for r in found} == want
    with pytest.raises(Exception, match="more than 12 vertices"):
        hilbert.hilbert_of_graphs(g6_encode(edges, 13), 3).collect()


#: Counting was left to the few tasks that small rows are put together in.
DEALT = ["g10_conjecture_c2", "g10_conjecture_c2_prime", "g10_conjecture_c6", "g03_top_coefficients", "g05_failing_histograms", "u03_hilbert_function"]


@pytest.mark.parametrize("name", DEALT)
def test_counting_is_dealt_over_tasks(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow[^\n]*sizes[^\n]*\n[^\n]*Repartition \d+, true", plan)


#: The band and the edges of its graphs were computed again for each side of a join.
ONCE = ["u04_negative_h_screen", "g06_numerators_by_edges", "g09_gorenstein_set", "g09_numerator_rules", "g09_theorem_rules"]


@pytest.mark.parametrize("name", ONCE)
def test_the_band_is_computed_once(spark, monkeypatch, name):
    asked = []
    for source in ("band", "edges"):
        real = getattr(base, source)
        monkeypatch.setattr(jobs, source, lambda *a, real=real, source=source: asked.append(source) or real(*a), raising=False)
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == ["band"]


def test_records_of_any_line_ends_are_searched_once(spark, tmp_path):
    """b19_results_from_blocks: each line was parsed again for each other line of its record, and the record for each use."""
    odd = "noise: 1\n====\nGraphNumber: 4\nIdeal: a: b\r\nX: \nY:z\nZ: a\rb\nW: end \nV: v\r\r\nGraphNumber:  5 \r\nA: 1\nB: 2\nA: \nGraphNumber: x\nA: 1\nGraphNumber: 6"
    (tmp_path / "odd").write_bytes(odd.encode())
    (tmp_path / "plain").write_bytes(b"GraphNumber: 7\nq: 1\nq: 2\nGraphNumber: 8\n\n a: 3\nb: 4\nGraphNumber: 9 9\nc: 1\n")
    want = {"4": {"Ideal": "a: b", "X": "", "W": "end", "V": "v"}, "5": {"B": "2", "A": ""}, "6": {}, "7": {"q": "2"}, "8": {"b": "4"}}
    found = text.read_blocks(spark, str(tmp_path))
    assert {r["kv"]["GraphNumber"]: r["kv"] for r in found.collect()} == {k: {"GraphNumber": k} | kv for k, kv in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?m)^") == 2 and plan.count("(?md)^") == 2
