"""Regressions with autocorrelation-robust errors, univariate screens and variance inflation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import autocovariances, long_run, newey_west_lags, normal_cdf
from .models import moments
from .relational import numbered


def _lags(n: Column, horizon: int | None) -> Column:
    return newey_west_lags(n) if horizon is None else F.lit(max(1, horizon - 1))


def univariate_screen(rows: DataFrame, features: list[str], label: str, order: str = "ts", horizon: int | None = None) -> DataFrame:
    """feature, n, coefficient, t, p, r2 of a regression of the label on each feature and a constant.

    Errors are Newey-West with the small-sample factor n / (n - 2); an overlapping label of `horizon` periods takes
    horizon - 1 lags. p has to be adjusted for the number of features by the caller. Constant features are left out.
    """
    long = rows.unpivot([order, label], features, "feature", "x").where(F.col("x").isNotNull() & F.col(label).isNotNull())
    x, y = F.col("x"), F.col(label)
    fit = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg(label).alias("my"), F.covar_pop("x", label).alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop(label).alias("vy"))
    fit = fit.where("n >= 10 and vx > 1e-300").withColumn("b", F.col("cxy") / F.col("vx"))
    score = (x - F.col("mx")) * (y - F.col("my") - F.col("b") * (x - F.col("mx")))
    scored = long.join(F.broadcast(fit), "feature").select("feature", order, score.alias("d"), "n", F.col("b").alias("mean"))  # fit: a row per feature
    series = numbered(scored, order, "i", "feature").drop(order)
    lags = _lags(F.col("n"), horizon)
    robust = long_run(autocovariances(series, "feature", lags), "feature", lags).select("feature", "lrv")
    n = F.col("n")
    error = F.sqrt(F.col("lrv") * n * n / (n - 2)) / (n * F.col("vx"))
    got = fit.join(robust, "feature").select("feature", "n", F.col("b").alias("coefficient"), (F.col("b") / error).alias("t"), F.try_divide(F.col("cxy") ** 2, F.col("vx") * F.col("vy")).alias("r2"))
    return got.withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def ols_hac(rows: DataFrame, features: list[str], label: str, order: str = "ts", horizon: int | None = None) -> DataFrame:
    """term, coefficient, std_error, t, p of a regression on all features and a constant, with Newey-West errors.

    The moments are one row, the products of the scores at each lag another; both are as many numbers as pairs of terms.
    """
    spark, d = rows.sparkSession, len(features)
    rows = rows.select(order, *(F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(features)), F.col(label).cast("double").alias("y")).dropna()
    names = [f"x{k}" for k in range(d)]
    got = moments(rows.withColumn("__all", F.lit(0)), names, "y", "__all").collect()
    if not got or got[0]["n"] <= d + 1:
        raise ValueError("too few complete rows")
    row = got[0]
    n, mean = row["n"], np.array([row[f"m_{i}"] for i in range(d + 1)])
    cov = np.array([[row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)])
    slope = np.linalg.solve(cov[:d, :d], cov[:d, d])
    beta = np.concatenate([[mean[d] - slope @ mean[:d]], slope])
    gram = np.zeros((d + 1, d + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0] = 1, mean[:d], mean[:d]
    gram[1:, 1:] = cov[:d, :d] + np.outer(mean[:d], mean[:d])
    lags = max(1, int(np.floor(4 * (n / 100) ** (2 / 9)))) if horizon is None else max(1, horizon - 1)
    residual = F.col("y") - float(beta[0]) - sum((float(b) * F.col(x) for b, x in zip(slope, names, strict=True)), F.lit(0.0))
    scored = rows.withColumn("u", residual).select(order, *(v.alias(f"z{k}") for k, v in enumerate([F.col("u"), *(F.col("u") * F.col(x) for x in names)])))
    placed = numbered(scored, order, "i").select("i", *(f"z{k}" for k in range(d + 1)))
    late = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("at", F.col("i") - F.col("lag"))
    early = placed.select(F.col("i").alias("at"), *(F.col(f"z{k}").alias(f"e{k}") for k in range(d + 1)))
    weight = 1 - F.col("lag") / (lags + 1)
    sums = late.join(early, "at").agg(*(F.sum(F.when(F.col("lag") == 0, F.col(f"z{i}") * F.col(f"e{j}")).otherwise(weight * (F.col(f"z{i}") * F.col(f"e{j}") + F.col(f"z{j}") * F.col(f"e{i}")))).alias(f"s{i}_{j}") for i in range(d + 1) for j in range(d + 1))).first()
    meat = np.array([[sums[f"s{i}_{j}"] for j in range(d + 1)] for i in range(d + 1)])
    bread = np.linalg.inv(n * gram)
    error = np.sqrt(np.diag(bread @ meat @ bread) * n / (n - d - 1))
    out = spark.createDataFrame([(t, float(b), float(e), float(b / e)) for t, b, e in zip(["const", *features], beta, error, strict=True)], "term string, coefficient double, std_error double, t double")
    return out.withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def variance_inflation(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, vif over the complete rows; above 10 a feature is nearly a mix of the others. Fewer than two give no rows."""
    spark, d = rows.sparkSession, len(features)
    if d < 2:
        return spark.createDataFrame([], "feature string, vif double")
    got = moments(rows.withColumn("__all", F.lit(0)), features[:-1], features[-1], "__all").collect()
    if not got:
        return spark.createDataFrame([], "feature string, vif double")
    cov = np.array([[got[0][f"c_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    sd = np.sqrt(np.diag(cov))
    vif = np.diag(np.linalg.inv(cov / np.outer(sd, sd)))
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, vif, strict=True)], "feature string, vif double")
