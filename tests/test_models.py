"""Trees, stored predictions and permutations against plain versions."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.operators import tree

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = random.Random(6)
    rows = []
    for k in range(240):
        a, b, c = rng.randint(0, 6), rng.randint(0, 3), rng.choice([None, 1, 2])
        rows.append((k, a, b, c, int((a > 3) != (b == 0)) if rng.random() < 0.9 else rng.randint(0, 1)))
    return rows


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table, "k long, a int, b int, c int, y int").repartition(3)


def value(r, name):
    v = r[1 + NAMES.index(name)]
    return -1.0 if v is None else float(v)


def plain_tree(table, depth, least):
    p, n = sum(r[4] for r in table), sum(1 - r[4] for r in table)
    gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
    splits, nodes = {}, {1: table}
    for _ in range(depth):
        after = {}
        for node, own in nodes.items():
            best = None
            if len({r[4] for r in own}) == 2:
                for name in NAMES:
                    seen = sorted({value(r, name) for r in own})
                    for lo, hi in zip(seen, seen[1:]):
                        left = [r for r in own if value(r, name) <= lo]
                        right = [r for r in own if value(r, name) > lo]
                        if len(left) >= least and len(right) >= least:
                            sides = [gini(sum(r[4] for r in s) / p, sum(1 - r[4] for r in s) / n) for s in (left, right)]
                            best = min(best or (9,), (round(sum(sides), 9), name, (lo + hi) / 2))
            if best:
                splits[node] = best[1:]
                after[2 * node] = [r for r in own if value(r, best[1]) <= best[2]]
                after[2 * node + 1] = [r for r in own if value(r, best[1]) > best[2]]
        nodes = after
    return splits


def passed(splits, r):
    node = 1
    while True:
        yield node
        if node not in splits:
            return
        name, threshold = splits[node]
        node = 2 * node + (value(r, name) > threshold)


@pytest.mark.parametrize(("depth", "least"), [(1, 3), (3, 3), (3, 40)])
def test_trees_and_their_nodes(spark, rows, table, depth, least):
    splits = tree.grow(rows, NAMES, "y", depth, least)
    assert splits == plain_tree(table, depth, least) and splits
    want = {}
    for r in table:
        for node in passed(splits, r):
            pos, neg = want.get(node, (0, 0))
            want[node] = pos + r[4], neg + 1 - r[4]
    found = {r["node"]: r for r in tree.node_table(splits, rows, "y").collect()}
    assert {k: (r["pos"], r["neg"]) for k, r in found.items()} == want
    assert all(r["is_leaf"] == (k not in splits) and r["depth"] == k.bit_length() - 1 for k, r in found.items())
    # the same rules on other rows: nodes that none of them reaches are there with nothing
    few = tree.node_table(splits, rows.limit(1), "y", (1.0, 1.0)).collect()
    assert len(few) == len(found) and sum(r["pos"] + r["neg"] for r in few if r["is_leaf"]) == 1
    assert tree.rule(splits, 3).startswith(splits[1][0] + " > ")


def test_a_tree_of_one_class_has_no_split(spark, rows):
    assert tree.grow(rows.filter("y = 1"), NAMES, "y", 2) == {}
    assert [r["node"] for r in tree.node_table({}, rows, "y").collect()] == [1]


def test_stored_predictions_and_their_scores(spark, rows, tmp_path):
    sets = {"A": ["a"], "B": ["a", "b", "c"]}
    scored = tree.out_of_fold(rows, sets, "k", "y", folds=3, rounds=2, depth=2)
    scored.coalesce(1).write.parquet(str(tmp_path / "scored"))
    assert scored.count() == 480 and scored.select("set", "k").distinct().count() == 480
    found = {r["set"]: r for r in tree.scores_by(scored, "set", "score", "y", F.floor(F.col("score") * 100)).collect()}
    sql = f"""WITH s AS (SELECT * FROM '{tmp_path}/scored/*.parquet'), q AS (SELECT a.set, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM s a JOIN s b ON a.set = b.set AND a.y = 1 AND b.y = 0 GROUP BY 1)
    SELECT s.set, avg(((score >= 0.5) = (y = 1))::INT), (avg((score >= 0.5)::INT) FILTER (y = 1) + avg((score < 0.5)::INT) FILTER (y = 0)) / 2, any_value(auc), count(*) FILTER (y = 1) FROM s JOIN q USING (set) GROUP BY 1"""
    for name, accuracy, balanced, auc, positives in duckdb.sql(sql).fetchall():
        r = found[name]
        assert np.allclose([r["accuracy"], r["balanced_accuracy"], r["auc"]], [accuracy, balanced, auc]) and r["positives"] == positives
    assert found["B"]["auc"] > 0.85 > found["A"]["auc"]  # both columns are needed
    other = tree.transferred(rows, rows.limit(50), sets, "k", "y", rounds=2, depth=2)
    assert other.count() == 100


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    # the label is noise, but each row's own feature value is unique: a model that saw a row could tell its label
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, float(k), rng.randint(0, 1)) for k in range(300)], "k long, x double, y int")
    scored = tree.out_of_fold(rows, {"x": ["x"]}, "k", "y", folds=3, rounds=4, depth=5)
    assert tree.scores_by(scored, "set", "score", "y", F.floor(F.col("score") * 100)).first()["auc"] < 0.65


def test_permutation_importance(spark, rows, table):
    score = lambda of: 3 * of("a") - of("b")
    found = {r["feature"]: r for r in tree.permutation_importance(rows, "k", NAMES, score, "y", F.floor("score")).collect()}
    code = lambda text: hashlib.md5(text.encode()).hexdigest()
    order = sorted(table, key=lambda r: (code(str(r[0])), str(r[0])))

    def auc(values):
        p, n = [v for v, r in zip(values, order) if r[4]], [v for v, r in zip(values, order) if not r[4]]
        return sum((x > y) + (x == y) / 2 for x in p for y in n) / len(p) / len(n)

    base = auc([3 * value(r, "a") - value(r, "b") for r in order])
    for name in NAMES:
        dealt = [value(r, name) for r in sorted(table, key=lambda r: (code(f"{name}:{r[0]}"), str(r[0])))]
        at = lambda r, k, c: dealt[k] if c == name else value(r, c)  # noqa: E731, B023
        want = auc([3 * at(r, k, "a") - at(r, k, "b") for k, r in enumerate(order)])
        assert found[name]["auc"] == pytest.approx(want) and found[name]["drop"] == pytest.approx(base - want)
    assert found["c"]["drop"] == 0 < found["a"]["drop"]


def test_poisson_draws():
    assert tree.POISSON[0] == 1580030168 and all(x < y < 1 << 32 for x, y in zip(tree.POISSON, tree.POISSON[1:]))
