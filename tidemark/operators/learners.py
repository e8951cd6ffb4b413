"""Logistic and tree models of pyspark.ml in the walk-forward, a registry of them, and their importances.

Each fold's fit is a distributed job over its training rows; the folds are a handful.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import forecast_metrics

SEED = 7


@dataclass(frozen=True)
class Learner:
    """make(rows, **params) gives an estimator for so many training rows; fewer than `least` rows are not fitted."""

    name: str
    task: str
    make: Callable
    least: int = 30
    params: dict = field(default_factory=dict)

    def having(self, **params) -> Learner:
        return Learner(self.name, self.task, self.make, self.least, self.params | params)


def _logistic(rows: int, C: float = 1.0, max_iter: int = 2000):
    """C weighs the summed loss against half the squared weights of standardised features."""
    return LogisticRegression(regParam=1 / (C * rows), maxIter=max_iter, standardization=True, tol=1e-9)


def _forest(kind, rows: int, trees: int = 300, depth: int = 6, leaf: int = 20, share: float = 0.5):
    return kind(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=str(share), seed=SEED)


def _boosted(kind, rows: int, iterations: int = 300, depth: int = 3, leaf: int = 40, rate: float = 0.03):
    return kind(maxIter=iterations, maxDepth=depth, minInstancesPerNode=leaf, stepSize=rate, seed=SEED)


LEARNERS: dict[str, Learner] = {}


def register(learner: Learner, replace: bool = False) -> Learner:
    if learner.task not in ("regression", "classification"):
        raise ValueError(f"unknown task {learner.task}")
    if learner.name in LEARNERS and not replace:
        raise ValueError(f"{learner.name} is registered")
    LEARNERS[learner.name] = learner
    return learner


def get(name: str, **params) -> Learner:
    if name not in LEARNERS:
        raise KeyError(f"unknown model {name}; there are {', '.join(sorted(LEARNERS))}")
    return LEARNERS[name].having(**params)


register(Learner("logistic", "classification", _logistic))
register(Learner("random_forest", "regression", lambda n, **p: _forest(RandomForestRegressor, n, **p), 100))
register(Learner("random_forest_clf", "classification", lambda n, **p: _forest(RandomForestClassifier, n, **p), 100))
register(Learner("gradient_boosting", "regression", lambda n, **p: _boosted(GBTRegressor, n, **p), 100))
register(Learner("gradient_boosting_clf", "classification", lambda n, **p: _boosted(GBTClassifier, n, **p), 100))


def _importances(model, features: list[str]) -> list[float]:
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    return [float(x) for x in model.coefficients.toArray()]


def walk_forward(dealt: DataFrame, features: list[str], learners: list[Learner], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(forecasts, importances) over the folds that labels.folds dealt.

    forecasts: model, fold, symbol, ts, y_pred, y_true of the test rows, y_pred being the probability of label 1 for a
    classifier. importances: model, fold, feature, importance. Rows with a null feature are left out; a fold with too
    few training rows, or with one class alone, is not fitted.
    """
    spark = dealt.sparkSession
    kind = dict(dealt.dtypes)["fold"]
    whole = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(dealt.dropna(subset=[*features, label]))
    rows = whole.select("fold", "role", "symbol", "ts", "__x", F.col(label).cast("double").alias("__y")).where("role in ('train', 'test')")
    sizes = rows.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("__y").alias("least"), F.max("__y").alias("most")).orderBy("fold").collect()
    made, weights = [], []
    for size in sizes:
        train = rows.where((F.col("fold") == size.fold) & (F.col("role") == "train")).persist()
        test = rows.where((F.col("fold") == size.fold) & (F.col("role") == "test"))
        for learner in learners:
            classes = learner.task == "classification"
            if size.n < learner.least or (classes and size.least == size.most):
                continue
            estimator = learner.make(size.n, **learner.params).setFeaturesCol("__x").setLabelCol("__y")
            model = estimator.fit(train)
            guess = vector_to_array("probability")[1] if classes else F.col("prediction")
            made.append(model.transform(test).select(F.lit(learner.name).alias("model"), "fold", "symbol", "ts", guess.alias("y_pred"), F.col("__y").alias("y_true")))
            weights += [(learner.name, size.fold, f, w) for f, w in zip(features, _importances(model, features), strict=True)]
        train.unpersist()
    empty = rows.limit(0).select(F.lit("").alias("model"), "fold", "symbol", "ts", F.lit(0.0).alias("y_pred"), F.col("__y").alias("y_true"))
    return reduce(DataFrame.unionByName, made, empty), spark.createDataFrame(weights, f"model string, fold {kind}, feature string, importance double")


def compare(dealt: DataFrame, features: list[str], ladder: list[Learner], label: str = "label") -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(metrics per model, forecasts, failed) of learners on the same folds.

    A learner whose fit is refused, or that no fold has enough training rows for, is left out and failed tells why; the
    others go on. A name that comes again gets a number.
    """
    made, failed, seen = [], {}, Counter()
    for learner in ladder:
        seen[learner.name] += 1
        name = learner.name if seen[learner.name] == 1 else f"{learner.name}_{seen[learner.name]}"
        try:
            forecasts, weights = walk_forward(dealt, features, [replace(learner, name=name)], label)
        except (ValueError, PySparkException) as refused:
            failed[name] = str(refused)
            continue
        if weights.isEmpty():
            failed[name] = "no fold has enough training rows"
            continue
        made.append(forecasts)
    empty = walk_forward(dealt.limit(0), features, [], label)[0]
    forecasts = reduce(DataFrame.unionByName, made, empty)
    return forecast_metrics(forecasts, "model"), forecasts, failed


def mean_importance(importances: DataFrame) -> DataFrame:
    """model, feature, importance: the mean of the absolute importances over the folds."""
    return importances.groupBy("model", "feature").agg(F.avg(F.abs("importance")).alias("importance"))


def majority_class(dealt: DataFrame, label: str = "label") -> DataFrame:
    """fold, symbol, ts, y_pred, predicted, y_true of the test rows: each fold's share of ones in training, and the commoner class."""
    share = dealt.where("role = 'train'").groupBy("fold").agg(F.avg(label).alias("y_pred"))
    test = dealt.where("role = 'test'").join(F.broadcast(share), "fold")
    return test.select("fold", "symbol", "ts", "y_pred", (F.col("y_pred") >= 0.5).cast("int").alias("predicted"), F.col(label).alias("y_true"))
