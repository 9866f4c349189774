"""Single-feature splits, folds, scores and trees."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphmill.operators.order import cumulative


def long_form(rows: DataFrame, features: list[str], label: str, extra: list[str] | None = None) -> DataFrame:
    """``feature, value, label``; nulls count as -1."""
    extra = extra or []
    own = rows.select(*extra, F.col(label).cast("long").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features])
    return own.unpivot([*extra, "label"], features, "feature", "value")


def best_splits(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The best threshold of each feature by class-balanced Gini impurity, with its balanced accuracy.

    ``counts``: ``feature, value, pos, neg`` (weights), already summed up by value; a feature's different values are
    few next to the rows. ``group`` makes it one search for each group.
    """
    group = [*(group or []), "feature"]
    up = Window.partitionBy(*group).orderBy("value")
    run, whole = up.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*group)
    r = counts.select(
        *group, "value", F.lead("value").over(up).alias("next"), F.sum("pos").over(run).alias("lp"), F.sum("neg").over(run).alias("ln"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"),
    ).filter("next is not null and p > 0 and n > 0")
    a, b = F.col("lp") / F.col("p"), F.col("ln") / F.col("n")
    gini = lambda x, y: F.when(x + y > 0, (x + y) * (1 - F.pow(x / (x + y), 2) - F.pow(y / (x + y), 2))).otherwise(0.0)
    r = r.withColumn("threshold", (F.col("value") + F.col("next")) / 2).withColumn("impurity", F.round(gini(a, b) + gini(1 - a, 1 - b), 9))
    r = r.withColumn("balanced", F.round(0.5 + F.abs(a - b) / 2, 9))
    rest = ["threshold", "impurity", "balanced", "lp", "ln", "p", "n"]
    return r.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct("impurity", "threshold")).alias("s")).select(*group, "s.*")


def split_counts(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    return long_form(rows, features, label).groupBy("feature", "value").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int, repeats: int = 1) -> DataFrame:
    """``repeat, key, label, fold``: within each label, the position in a hashed order modulo k."""
    code = F.md5(F.concat_ws(":", F.col("repeat").cast("string"), F.col(key).cast("string")))
    own = rows.select(key, label).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("code", code)
    placed = cumulative(own, ["repeat", label], F.left("code", F.lit(2)), ["code", key], {})
    return placed.select("repeat", key, label, ((F.col("position") - 1) % k).alias("fold"))


def scores(rows: DataFrame, score: str, label: str, coarse: F.Column) -> DataFrame:
    """One row: accuracy at 0.5 is left to the caller; AUC with ties averaged, average precision over different scores,
    positives and negatives. ``coarse`` never rises as the score falls."""
    by = rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    curve = cumulative(by.withColumn("one", F.lit(0)), ["one"], -coarse, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    total = curve.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    rows = curve.crossJoin(F.broadcast(total))
    return rows.agg(
        F.round(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.first(F.col("p") * F.col("n")), 9).alias("auc"),
        F.round(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("p"), 9).alias("average_precision"),
        F.max("p").alias("positives"), F.max("n").alias("negatives"),
    )


def confusion_scores(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    p, t = F.col(predicted) == 1, F.col(label) == 1
    c = rows.agg(F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"), F.count_if(t).alias("p"), F.count_if(~t).alias("n"))
    return c.select(F.round((F.col("tp") + F.col("tn")) / (F.col("p") + F.col("n")), 9).alias("accuracy"), F.round((F.try_divide("tp", "p") + F.try_divide("tn", "n")) / 2, 9).alias("balanced_accuracy"))


def _balanced(rows: DataFrame, label: str) -> DataFrame:
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    total = sum(sizes.values())
    return rows.withColumn("weight", F.when(F.col(label) == 1, total / (2 * max(1, sizes.get(1, 0)))).otherwise(total / (2 * max(1, sizes.get(0, 0))))).withColumn("label", F.col(label).cast("double"))


def _fit(rows: DataFrame, features: list[str], label: str, learner):
    filled = _balanced(rows.fillna(-1, features), label)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="vector"), learner.setFeaturesCol("vector").setLabelCol("label").setWeightCol("weight")]).fit(filled)


def fit_tree(rows: DataFrame, features: list[str], label: str, depth: int):
    """A class-balanced tree of little depth."""
    return _fit(rows, features, label, DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=3, seed=1))


def fit_boosted(rows: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3):
    return _fit(rows, features, label, GBTClassifier(maxIter=rounds, maxDepth=depth, seed=1))


def predicted(model, rows: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(rows.fillna(-1, features)).withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability")


def tree_rules(model, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """``rule, pos, neg``: each leaf of a fitted tree as its conditions, with the rows that end in it."""
    lines = model.stages[-1].toDebugString.split("\n")[1:]
    path: list[str] = []
    leaves: list[tuple[str, F.Column]] = []
    conditions: list[F.Column] = []
    for line in lines:
        depth, text = (len(line) - len(line.lstrip())) - 2, line.strip()
        del path[depth:], conditions[depth:]
        if text.startswith(("If", "Else")):
            _, number, op, value = text[text.index("(") + 1 : -1].split(" ")
            name = features[int(number)]
            path.append(f"{name} {op} {value}")
            conditions.append(F.col(name) <= float(value) if op == "<=" else F.col(name) > float(value))
        elif text.startswith("Predict"):
            rule = F.lit(True)
            for c in conditions:
                rule = rule & c
            leaves.append((" and ".join(path) or "all", rule))
    own = rows.fillna(-1, features)
    out = own.agg(*[F.struct(F.lit(name).alias("rule"), F.count_if(c & (F.col(label) == 1)).alias("pos"), F.count_if(c & (F.col(label) == 0)).alias("neg")).alias(f"leaf{k}") for k, (name, c) in enumerate(leaves)])
    return out.select(F.explode(F.array(*[f"leaf{k}" for k in range(len(leaves))])).alias("r")).select("r.*")


def importance(model, features: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(name, float(v)) for name, v in zip(features, values)], "feature string, importance double")


def root_stability(rows: DataFrame, key: str, features: list[str], label: str, reps: int) -> DataFrame:
    """``feature, wins``: how often each feature gives the best first split over ``reps`` bootstraps. A row's weight in
    a bootstrap is Poisson(1) by a hash, so nothing is drawn or moved; counts by value come before any window."""
    u = F.pmod(F.xxhash64(F.col("rep"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = sum(((u >= s).cast("long") for s in steps), F.lit(0).cast("long"))
    own = long_form(rows, features, label, [key]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", weight)
    counts = own.filter("w > 0").groupBy("rep", "feature", "value").agg(F.sum(F.col("w") * F.col("label")).alias("pos"), F.sum(F.col("w") * (1 - F.col("label"))).alias("neg"))
    best = best_splits(counts, ["rep"]).groupBy("rep").agg(F.min_by("feature", F.struct("impurity", "feature")).alias("feature"))
    return best.groupBy("feature").agg(F.count(F.lit(1)).alias("wins"))
