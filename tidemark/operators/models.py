"""Linear forecasts and baselines, fitted per group from moments that Spark aggregates.

A fit needs only counts, means and covariances of the training rows. These are one aggregation over all groups, with
one number per pair of features for each; the tasks that hold them solve them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer training rows give no fit.
LEAST_ROWS = 30


def ridge(n: int, corr: np.ndarray, target: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Weights of standardised features under a squared penalty."""
    return np.linalg.solve(n * corr + alpha * np.eye(len(target)), n * target)


def elastic_net(n: int, corr: np.ndarray, target: np.ndarray, alpha: float = 0.01, l1_ratio: float = 0.5, rounds: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """Weights under mixed penalties, one coordinate at a time; l1_ratio 1 is the lasso."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            pull = target[j] - corr[j] @ w + corr[j, j] * w[j]
            w[j] = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / (corr[j, j] + alpha * (1 - l1_ratio))
        if np.abs(w - before).max(initial=0.0) < tolerance:
            break
    return w


def moments(rows: DataFrame, features: list[str], label: str, by: str) -> DataFrame:
    """One row per group: n, means and population covariances of the rows without nulls."""
    names = [*features, label]
    rows = rows.select(by, *(F.col(x).cast("double").alias(x) for x in names)).dropna(subset=names)
    means = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)]
    pairs = [F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in combinations_with_replacement(range(len(names)), 2)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means, *pairs)


def fit(rows: DataFrame, features: list[str], label: str, by: str, solver: Callable = ridge, **how) -> DataFrame:
    """(by, n, intercept, coefficients) per group with LEAST_ROWS complete rows or more; constant features weigh nothing.

    A group is solved where its row of moments is, so there may be as many groups as a table can hold.
    """
    d = len(features)
    pairs = list(combinations_with_replacement(range(d + 1), 2))

    def weigh(row: dict) -> tuple[float, list[float]]:
        mean = np.array([row[f"m_{i}"] for i in range(d + 1)])
        cov = np.zeros((d + 1, d + 1))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"]
        sd = np.sqrt(np.diag(cov)[:d])
        sd[sd < 1e-12] = np.inf
        weights = solver(row["n"], cov[:d, :d] / np.outer(sd, sd), cov[:d, d] / sd, **how) / sd
        return float(mean[d] - weights @ mean[:d]), weights.tolist()

    def solved(batches):
        for batch in batches:
            found = [weigh(row) for row in batch.to_dict("records")]
            yield pd.DataFrame({by: batch[by], "n": batch["n"], "intercept": [a for a, _ in found], "coefficients": [w for _, w in found]})

    kind = rows.schema[by].dataType.simpleString()
    return moments(rows, features, label, by).where(F.col("n") >= LEAST_ROWS).mapInPandas(solved, f"`{by}` {kind}, n long, intercept double, coefficients array<double>")


def predict(rows: DataFrame, fitted: DataFrame, features: list[str], by: str) -> DataFrame:
    """rows with y_pred; null where a feature is null. fitted has one row per group; Spark broadcasts it only if its measured size allows."""
    joined = rows.join(fitted.select(by, "intercept", "coefficients"), by)
    total = F.col("intercept")
    for i, x in enumerate(features):
        total = total + F.col("coefficients")[i] * F.col(x)
    return joined.withColumn("y_pred", total).drop("intercept", "coefficients")


def walk_forward(dealt: DataFrame, features: list[str], label: str = "label", models: dict[str, tuple[Callable, dict]] | None = None) -> DataFrame:
    """model, fold, symbol, ts, y_pred, y_true of the test rows of every fold; dealt comes from labels.folds.

    The baselines zero, historical_mean (of the fold's training labels) and last_value (the first feature, 0 if absent)
    stand beside the models.
    """
    models = {"ridge": (ridge, {}), "elastic_net": (elastic_net, {})} if models is None else models
    train, test = dealt.where("role = 'train'"), dealt.where("role = 'test'")
    key = ["fold", "symbol", "ts"]
    means = train.groupBy("fold").agg(F.avg(label).alias("mean"))
    based = test.join(F.broadcast(means), "fold")
    base = F.array(*(F.struct(F.lit(k).alias("model"), v.alias("y_pred")) for k, v in {"zero": F.lit(0.0), "historical_mean": F.col("mean"), "last_value": F.coalesce(F.col(features[0]), F.lit(0.0))}.items()))
    out = based.select(*key, F.explode(base).alias("b"), F.col(label).alias("y_true")).select("b.model", *key, "b.y_pred", "y_true")
    for name, (solver, how) in models.items():
        made = predict(test, fit(train, features, label, "fold", solver, **how), features, "fold")
        out = out.unionByName(made.select(F.lit(name).alias("model"), *key, "y_pred", F.col(label).alias("y_true")))
    return out.where("y_pred is not null")
