"""Queries of the modelling operators, on line items (is a line returned?) and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.jobs.base import table
from graphmill.operators import model as ops
from graphmill.registry import query

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def rows(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in FEATURES], (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return lines


GINI = "CASE WHEN ({x}) + ({y}) > 0 THEN (({x}) + ({y})) * (1 - pow(({x}) / (({x}) + ({y})), 2) - pow(({y}) / (({x}) + ({y})), 2)) ELSE 0 END"
SPLITS = (
    "l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, (l_returnflag = 'R')::INT AS label FROM lineitem" for c in FEATURES)
    + """), c AS (SELECT feature, value, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM l GROUP BY 1, 2),
r AS (SELECT feature, value, lead(value) OVER u AS next, sum(pos) OVER u AS lp, sum(neg) OVER u AS ln, sum(pos) OVER (PARTITION BY feature) AS p, sum(neg) OVER (PARTITION BY feature) AS n FROM c WINDOW u AS (PARTITION BY feature ORDER BY value)),
s AS (SELECT feature, (value + next) / 2 AS threshold, round("""
    + GINI.format(x="lp / p", y="ln / n")
    + " + "
    + GINI.format(x="1 - lp / p", y="1 - ln / n")
    + """, 9) AS impurity, round(0.5 + abs(lp / p - ln / n) / 2, 9) AS balanced, lp, ln, p, n FROM r WHERE next IS NOT NULL AND p > 0 AND n > 0)"""
)


@query("m01_best_splits", f"WITH {SPLITS} SELECT feature, threshold, balanced, lp, ln, p, n FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY impurity, threshold) AS rn FROM s) WHERE rn = 1")
def m01(spark, sf):
    return ops.best_splits(ops.split_counts(rows(spark, sf), FEATURES, "returned")).select("feature", "threshold", "balanced", *[F.col(c).cast("double").alias(c) for c in ("lp", "ln", "p", "n")])


@query(
    "m02_stratified_folds",
    "WITH r AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS label, unnest(range(3)) AS repeat FROM orders) SELECT repeat, o_orderkey, label, (row_number() OVER (PARTITION BY repeat, label ORDER BY md5(repeat || ':' || o_orderkey), o_orderkey) - 1) % 5 AS fold FROM r",
)
def m02(spark, sf):
    own = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return ops.stratified_folds(own, "o_orderkey", "label", 5, 3)


@query(
    "m03_scores",
    """WITH b AS (SELECT l_quantity AS score, sum((l_returnflag = 'R')::INT) AS pos, sum((l_returnflag <> 'R')::INT) AS neg FROM lineitem GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM b WINDOW w AS (ORDER BY score DESC)), t AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM b)
    SELECT round((SELECT sum(neg * (tp - pos / 2::DOUBLE)) FROM c) / (p * n), 9) AS auc, round((SELECT sum(pos * tp / (tp + fp)::DOUBLE) FROM c) / p, 9) AS average_precision, p::BIGINT AS positives, n::BIGINT AS negatives FROM t""",
)
def m03(spark, sf):
    return ops.scores(rows(spark, sf), "l_quantity", "returned", F.floor(F.col("score") / 5))


@query(
    "m03_accuracy",
    """SELECT round(avg(((l_quantity > 25) = (l_returnflag = 'R'))::INT), 9) AS accuracy, round((count(*) FILTER (l_quantity > 25 AND l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R')::DOUBLE
    + count(*) FILTER (l_quantity <= 25 AND l_returnflag <> 'R') / count(*) FILTER (l_returnflag <> 'R')::DOUBLE) / 2, 9) AS balanced_accuracy FROM lineitem""",
)
def m03_accuracy(spark, sf):
    return ops.confusion_scores(rows(spark, sf).withColumn("guess", (F.col("l_quantity") > 25).cast("int")), "guess", "returned")


@query("m04_tree_rules")
def m04(spark, sf):
    own = rows(spark, sf)
    return ops.tree_rules(ops.fit_tree(own, FEATURES, "returned", 3), own, FEATURES, "returned")


@query("m05_boosted_trees")
def m05(spark, sf):
    own = rows(spark, sf).withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(5)))
    model = ops.fit_boosted(own.filter("fold > 0"), FEATURES, "returned", rounds=5)
    return ops.scores(ops.predicted(model, own.filter("fold = 0"), FEATURES), "score", "returned", F.floor(F.col("score") * 100))


@query("m06_root_stability")
def m06(spark, sf):
    return ops.root_stability(rows(spark, sf).withColumn("row", F.xxhash64("l_orderkey", *FEATURES)), "row", FEATURES, "returned", 20)


@query("m07_importance")
def m07(spark, sf):
    return ops.importance(ops.fit_tree(rows(spark, sf), FEATURES, "returned", 4), FEATURES, spark)
