"""Conjectures and presets of the research log, on rows made by hand."""

from pyspark.sql import functions as F

from graphmill.jobs import conjectures as jobs
from graphmill.operators import relate

SCHEMA = "n int, graph_number long, fails_occ int, is_cm int, is_gorenstein int, is_ci int, sep_same_block_pairs int, even_cycle_meets_pair int, is_hamiltonian int, h array<int>, truncated boolean"
ROWS = [
    (9, 8866, 1, 1, 1, 0, 0, 0, 0, [1, 3, 3, 3, 3, 1, 0, 0, 0, 0], False),  # Gorenstein, not CI
    (9, 7161, 1, 0, 0, 0, 0, 0, 0, [1, 2, 3, 4, 3, 1, -1, 0, 0, 0], False),  # C4 predicts CM
    (9, 52930, 1, 1, 0, 0, 1, 1, 0, [1, 5, 8, 2, 0, 0, 0, 0, 0, 0], False),  # CM with a pair inside one block
    (9, 1, 0, 1, 0, 0, 0, 0, 1, None, None),  # satisfies OCC, Hamiltonian, CM: no counterexample to C5
    (9, 2, 1, None, None, None, 1, 1, 1, [1, 2, 0, 0, 0, 0, 0, 0, 0, 1], True),
]
FAILS = {"c1": [8866], "c2": [], "c2_prime": [], "c3": [52930], "c4": [7161, 52930], "c4_prime": [52930], "c5": [], "c6": []}


def test_statements(spark):
    rows = jobs.numerators(spark.createDataFrame(ROWS, SCHEMA)).cache()
    assert list(jobs.CONJECTURES) == list(FAILS)
    for name, (h, c) in jobs.CONJECTURES.items():
        total = relate.test_conjecture(rows, F.expr(h), F.expr(c), "graph_number").filter("n is null").first()
        assert (total["fails"], total["counterexample"]) == (len(FAILS[name]), min(FAILS[name], default=None)), name
    assert len(jobs.PRESETS) == 9
    hits = {name: {r["graph_number"] for r in rows.filter(c).collect()} for name, c in jobs.PRESETS.items()}
    assert hits["c3_group"] == {52930, 2} and hits["c3_exceptions"] == {7161} and hits["cut_linked_cm"] == {8866} and hits["c4_counterexamples"] == {7161, 52930}
