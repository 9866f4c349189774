"""Class-balanced trees as tables of nodes, cross-validation over feature sets, and importance by permutation.

A tree is grown level by level over counts of (node, feature, value): a level is one aggregation and one window over the
different values of a feature in a node, and only the chosen splits (at most one for each node) come to the driver. Nodes
are numbered as in a heap: 1 is the root, and node k has the children 2 k (value <= threshold) and 2 k + 1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import exp, factorial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.operators.model import best_splits, fit_boosted, long_form, predicted, stratified_folds
from graphmill.operators.order import cumulative
from graphmill.scratch import written

Splits = dict[int, tuple[str, float]]


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(-1.0))


def leaf(splits: Splits, node: int = 1) -> Column:
    """The leaf of a row. Nulls count as -1."""
    if node not in splits:
        return F.lit(node)
    feature, threshold = splits[node]
    return F.when(_filled(feature) <= threshold, leaf(splits, 2 * node)).otherwise(leaf(splits, 2 * node + 1))


def grow(rows: DataFrame, features: Sequence[str], label: str, depth: int, least: int = 3) -> Splits:
    """The splits of a tree that minimise the class-balanced Gini impurity (each class weighs half at the root), with at
    least ``least`` rows on either side; ties go to the first feature by name and its least threshold. A node of one class
    is not split."""
    own = written(rows.select(F.col(label).cast("long").alias(label), *features), "tree-rows")
    pos, neg = own.agg(F.coalesce(F.sum(label), F.lit(0)), F.coalesce(F.sum(1 - F.col(label)), F.lit(0))).first()
    splits: Splits = {}
    if not pos or not neg:
        return splits
    for level in range(depth):
        at = own.withColumn("node", leaf(splits)).filter(F.col("node") >= 1 << level)
        counts = long_form(at, list(features), label, ["node"]).groupBy("node", "feature", "value").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
        up = Window.partitionBy("node", "feature").orderBy("value")
        run, whole = up.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("node", "feature")
        r = counts.select(
            "node", "feature", ((F.col("value") + F.lead("value").over(up)) / 2).alias("threshold"), F.sum("pos").over(run).alias("lp"), F.sum("neg").over(run).alias("ln"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"),
        )
        left, right = F.col("lp") + F.col("ln"), F.col("p") - F.col("lp") + F.col("n") - F.col("ln")
        r = r.filter(F.col("threshold").isNotNull() & (F.col("p") > 0) & (F.col("n") > 0) & (left >= least) & (right >= least))
        impurity = _gini(F.col("lp") / pos, F.col("ln") / neg) + _gini((F.col("p") - F.col("lp")) / pos, (F.col("n") - F.col("ln")) / neg)
        best = r.groupBy("node").agg(F.min(F.struct(F.round(impurity, 9).alias("impurity"), "feature", "threshold")).alias("s"))
        found = best.select("node", "s.feature", "s.threshold").collect()  # a row for each node of the level
        if not found:
            break
        splits |= {r["node"]: (r["feature"], r["threshold"]) for r in found}
    return splits


def _gini(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def node_table(splits: Splits, rows: DataFrame, label: str, weights: tuple[float, float] | None = None) -> DataFrame:
    """``node, depth, feature, threshold, is_leaf, pos, neg, predicted`` of all nodes, with the rows of ``rows`` that pass
    each: counted once by leaf and rolled up the ancestors. ``predicted``: 1 where ``pos / weights[0]`` is more than
    ``neg / weights[1]`` (by default the classes of ``rows`` weigh the same)."""
    spark = rows.sparkSession
    by_leaf = rows.groupBy(leaf(splits).alias("leaf")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    up = F.array(*[F.shiftright("leaf", k) for k in range(max(splits, default=1).bit_length() + 1)])
    counts = by_leaf.select(F.explode(up).alias("node"), "pos", "neg").filter("node > 0").groupBy("node").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    nodes = sorted({1, *splits, *(c for k in splits for c in (2 * k, 2 * k + 1))})
    known = spark.createDataFrame([(k, k.bit_length() - 1, *splits.get(k, (None, None)), k not in splits) for k in nodes], "node long, depth int, feature string, threshold double, is_leaf boolean")
    out = known.join(F.broadcast(counts), "node", "left").fillna(0, ["pos", "neg"])
    if weights is None:
        weights = tuple(float(x or 0) for x in rows.agg(F.sum(F.col(label).cast("long")), F.sum(1 - F.col(label).cast("long"))).first())
    more = F.col("pos") * F.lit(weights[1]) > F.col("neg") * F.lit(weights[0])
    return out.withColumn("predicted", more.cast("int"))


def rule(splits: Splits, node: int) -> str:
    """The conditions of a node, from the root."""
    path = []
    while node > 1:
        feature, threshold = splits[node // 2]
        path.append(f"{feature} {'<=' if node % 2 == 0 else '>'} {threshold:g}")
        node //= 2
    return " and ".join(reversed(path)) or "all"


def out_of_fold(rows: DataFrame, sets: dict[str, list[str]], key: str, label: str, folds: int = 5, parallel: int = 4, **boosting) -> DataFrame:
    """``set, key, label, score``: for each named feature set the score of every row by boosted trees that were fitted on
    the other folds. Folds are stratified by hashed order; fits run side by side."""
    own = written(rows.join(stratified_folds(rows, key, label, folds).select(key, "fold"), key), "folds")

    def fitted(job: tuple[str, int]) -> DataFrame:
        name, fold = job
        model = fit_boosted(own.filter(F.col("fold") != fold), sets[name], label, **boosting)
        scored = predicted(model, own.filter(F.col("fold") == fold), sets[name])
        return written(scored.select(F.lit(name).alias("set"), key, F.col(label).cast("int").alias(label), "score"), "out-of-fold")

    return _each(rows.sparkSession, fitted, [(name, fold) for name in sets for fold in range(folds)], parallel)


def transferred(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], key: str, label: str, parallel: int = 4, **boosting) -> DataFrame:
    """``set, key, label, score`` of the rows of ``test`` by trees that were fitted on all of ``train``."""
    train, test = written(train, "train"), written(test, "test")

    def fitted(name: str) -> DataFrame:
        scored = predicted(fit_boosted(train, sets[name], label, **boosting), test, sets[name])
        return written(scored.select(F.lit(name).alias("set"), key, F.col(label).cast("int").alias(label), "score"), "transferred")

    return _each(train.sparkSession, fitted, list(sets), parallel)


def _each(spark: SparkSession, f: Callable, jobs: list, parallel: int) -> DataFrame:
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(f), jobs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scores_by(rows: DataFrame, group: str, score: str, label: str, coarse: Column, at: float = 0.5) -> DataFrame:
    """``group, accuracy, balanced_accuracy, auc, positives, negatives``: for scores at least ``at`` the class is 1; the AUC
    averages ties. ``coarse`` (over ``score``) never rises as the score falls. Groups without both classes get nulls."""
    by = rows.groupBy(group, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    curve = cumulative(by, [group], -coarse, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    high = F.col("score") >= at
    found = curve.groupBy(group).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("hit"), F.sum(F.when(high, 0).otherwise(F.col("neg"))).alias("passed"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return found.select(
        group, F.round((F.col("hit") + F.col("passed")) / (p + n), 9).alias("accuracy"), F.round((F.try_divide(F.col("hit"), p) + F.try_divide(F.col("passed"), n)) / 2, 9).alias("balanced_accuracy"),
        F.round(F.try_divide(F.col("area"), p * n), 9).alias("auc"), "positives", "negatives",
    )


def permutation_importance(rows: DataFrame, key: str, features: Sequence[str], score: Callable[[Callable[[str], Column]], Column], label: str, coarse: Column) -> DataFrame:
    """``feature, auc, drop``: the AUC of a score when one column's values are dealt anew, and how much is lost against the
    AUC as it is. A row takes the value of the row whose place by ``md5(feature:key)`` is its own place by ``md5(key)``: a
    permutation that is the same on any cluster, and one join for all columns. ``score`` builds the score from a function
    that gives the column of a feature."""
    own = written(rows.select(F.col(key).cast("string").alias("key"), F.col(label).cast("long").alias("label"), *[_filled(c).alias(c) for c in features]), "permutation-rows")
    dealt = own.unpivot(["key"], list(features), "feature", "value").withColumn("code", F.md5(F.concat_ws(":", "feature", "key")))
    dealt = cumulative(dealt, ["feature"], F.left("code", F.lit(2)), ["code", "key"], {}).select("feature", "value", "position")
    placed = cumulative(own.withColumns({"code": F.md5("key"), "one": F.lit(1)}), ["one"], F.left("code", F.lit(2)), ["code", "key"], {}).drop("code", "one")
    met = placed.join(dealt, "position")
    changed = F.lit(None).cast("double")
    for name in features:
        changed = F.when(F.col("feature") == name, score(lambda c, name=name: F.col("value") if c == name else F.col(c)).cast("double")).otherwise(changed)
    plain = own.select(F.lit("").alias("feature"), "label", score(F.col).cast("double").alias("score"))
    auc = written(scores_by(met.select("feature", "label", changed.alias("score")).unionByName(plain), "feature", "score", "label", coarse).select("feature", "auc"), "permutation-auc")
    base = auc.filter("feature = ''").select(F.col("auc").alias("base"))  # one row
    return auc.filter("feature <> ''").crossJoin(F.broadcast(base)).select("feature", "auc", F.round(F.col("base") - F.col("auc"), 9).alias("drop"))


#: Of 2^32: a draw below the first is 0, below the second 1, and so on (Poisson with mean 1).
POISSON = [int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(6)]


def bootstrap_roots(rows: DataFrame, key: str, features: Sequence[str], label: str, reps: int) -> DataFrame:
    """``feature, wins``: how often each feature gives the best first split over ``reps`` resamples. A row's weight in one is
    Poisson(1) by ``md5(rep:key)``, so nothing is drawn; counts by value are summed up before any window."""
    draw = F.conv(F.left(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("key").cast("string"))), F.lit(8)), 16, 10).cast("long")
    weight = sum(((draw >= limit).cast("long") for limit in POISSON), F.lit(0).cast("long"))
    own = rows.select(F.col(key).alias("key"), F.col(label).cast("long").alias("label"), *features)
    drawn = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", weight).filter("w > 0")
    counts = long_form(drawn, list(features), "label", ["rep", "w"]).groupBy("rep", "feature", "value")
    counts = counts.agg(F.sum(F.col("w") * F.col("label")).alias("pos"), F.sum(F.col("w") * (1 - F.col("label"))).alias("neg"))
    best = best_splits(counts, ["rep"]).groupBy("rep").agg(F.min_by("feature", F.struct("impurity", "feature")).alias("feature"))
    return best.groupBy("feature").agg(F.count(F.lit(1)).alias("wins"))
