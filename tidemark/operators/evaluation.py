"""Forecast evaluation, rank statistics, significance and multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .inference import autocovariances, centred, long_run, student_p

EPS = 1e-12


def average_rank(value: str, *by: str) -> Column:
    """Rank in which ties share the mean of their places."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2


def r2_against(preds: DataFrame, benchmark: str, *by: str) -> DataFrame:
    """Out-of-sample R2 of y_pred against the forecasts in a benchmark column, as the training mean, per group."""
    y = F.col("y_true")
    rows = preds.where(y.isNotNull() & F.col("y_pred").isNotNull() & F.col(benchmark).isNotNull())
    base = F.sum((y - F.col(benchmark)) ** 2)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum((y - F.col("y_pred")) ** 2), F.when(base > EPS, base))).alias("r2"))


def forecast_metrics(preds: DataFrame, *by: str) -> DataFrame:
    """Losses, out-of-sample R2 against zero, directional accuracy and correlation per group; finite pairs only."""
    y, p = F.col("y_true"), F.col("y_pred")
    finite = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    right = F.when(F.abs(p) > EPS, (F.signum(y) == F.signum(p)).cast("double"))
    spread = (F.stddev_samp(y) > EPS) & (F.stddev_samp(p) > EPS) & (F.count(F.lit(1)) >= 3)
    return preds.where(finite).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) ** 2).alias("mse"),
        F.sqrt(F.avg((y - p) ** 2)).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(F.sum((y - p) ** 2), F.when(F.sum(y**2) > EPS, F.sum(y**2)))).alias("r2_zero"),
        F.avg(right).alias("directional_accuracy"),
        F.when(spread, F.try_divide(F.covar_samp(y, p), F.stddev_samp(y) * F.stddev_samp(p))).alias("ic"),
    )


def rank_ic(preds: DataFrame, *by: str) -> DataFrame:
    """Spearman correlation of forecasts and outcomes per group, ties by average ranks."""
    ranked = preds.select(*by, average_rank("y_true", *by).alias("ry"), average_rank("y_pred", *by).alias("rp"))
    flat = F.stddev_samp("rp") > EPS
    return ranked.groupBy(*by).agg(F.when(flat, F.try_divide(F.covar_samp("ry", "rp"), F.stddev_samp("ry") * F.stddev_samp("rp"))).alias("rank_ic"))


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """Area under the curve from average ranks; rows have label (0/1) and score."""
    ranked = scored.select(*by, "label", average_rank("score", *by).alias("r"))
    n1, n0 = F.sum("label"), F.sum(1 - F.col("label"))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("r") * F.col("label")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def log_loss_brier(scored: DataFrame, *by: str) -> DataFrame:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    y = F.col("label")
    return scored.groupBy(*by).agg(
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg((y - F.col("score")) ** 2).alias("brier"), F.avg(((F.col("score") >= 0.5).cast("int") == y).cast("double")).alias("accuracy")
    )


def paired_forecasts(preds: DataFrame, candidate: str, baseline: str, tolerance: float = 1e-12) -> DataFrame:
    """symbol, ts, y_true, y_pred, y_pred_base where both models have a forecast; two targets that differ are an error when the row is read."""
    base = preds.where(F.col("model") == baseline).select("symbol", "ts", F.col("y_pred").alias("y_pred_base"), F.col("y_true").alias("__other"))
    both = preds.where(F.col("model") == candidate).select("symbol", "ts", "y_true", "y_pred").join(base, ["symbol", "ts"])
    same = F.col("y_true").eqNullSafe(F.col("__other")) | (F.abs(F.col("y_true") - F.col("__other")) <= tolerance)
    message = F.concat(F.lit("targets differ for "), F.col("symbol"), F.lit(" at "), F.col("ts").cast("string"))
    target = F.when(F.coalesce(same, F.lit(False)), F.col("y_true")).otherwise(F.raise_error(message).cast("double"))
    return both.select("symbol", "ts", target.alias("y_true"), "y_pred", "y_pred_base")


def daily_loss_differential(preds: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Mean over symbols per date of the candidate's squared loss minus the baseline's."""
    a, b = (preds.where(F.col("model") == m).select("symbol", "ts", "y_true", F.col("y_pred").alias(n)) for m, n in ((candidate, "pa"), (baseline, "pb")))
    both = a.join(b.drop("y_true"), ["symbol", "ts"])
    return both.groupBy("ts").agg(F.avg((F.col("y_true") - F.col("pa")) ** 2 - (F.col("y_true") - F.col("pb")) ** 2).alias("d"))


def diebold_mariano(diff: DataFrame, horizon: int = 1, lags: int | None = None, correct: bool = True, by: str | None = None) -> DataFrame:
    """n, lags, mean, statistic and p of a loss differential (ts, d), of each group if by is given: negative values favour the candidate.

    The long-run variance has Bartlett weights; without given lags they follow the number of dates and the horizon. The
    small-sample correction and the t distribution hold for short samples. Fewer than 10 dates give no row.
    """
    if horizon < 1:
        raise ValueError("the horizon must be positive")
    n = F.col("n")
    chosen = F.lit(lags) if lags is not None else F.greatest(F.lit(horizon - 1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int"))
    key = by or "__all"
    rows = diff.where(~F.isnan("d"))
    series = centred(rows if by else rows.withColumn(key, F.lit(0)), "d", key, "ts").where(n >= 10)
    got = long_run(autocovariances(series, key, chosen), key, chosen)
    factor = F.sqrt(F.greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n, F.lit(1e-12))) if correct else F.lit(1.0)
    statistic = F.try_divide(F.col("mean"), F.sqrt(F.col("lrv") / n)) * factor
    return got.select(*([by] if by else []), "n", "lags", "mean", statistic.alias("statistic")).withColumn("p", student_p("statistic", F.col("n") - 1))


def paired_t(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """n, mean difference, t and p of a - b per group; fewer than two pairs or equal differences give null."""
    d = F.col(a) - F.col(b)
    got = rows.groupBy(by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).where("n > 0")
    t = F.try_divide(F.col("mean") * F.sqrt("n"), F.when(F.col("sd") > EPS, F.col("sd")))
    return got.select(by, "n", "mean", t.alias("t")).withColumn("p", student_p("t", F.col("n") - 1))


def adjust_pvalues(tests: DataFrame, p: str = "p", method: str = "bh") -> DataFrame:
    """tests with p_adjusted by Benjamini-Hochberg ('bh') or Bonferroni."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    if method == "bonferroni":
        return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * n))
    # equal values share a row, so what one task sorts are the distinct values of p alone
    counts = tests.groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__many")).where("__p is not null")
    below = F.sum("__many").over(W.orderBy("__p"))
    total = F.sum("__many").over(W.partitionBy())
    raw = counts.select("__p", (F.col("__p") * total / below).alias("__raw"))
    least = raw.select("__p", F.least(F.lit(1.0), F.min("__raw").over(W.orderBy("__p").rowsBetween(0, W.unboundedFollowing))).alias("p_adjusted"))
    return tests.join(least, F.col(p) == F.col("__p"), "left").drop("__p")


def infer_periods(rows: DataFrame, by: str = "symbol", order: str = "ts", default: int = 252) -> DataFrame:
    """by, periods a year from the median gap between rows; groups of fewer than three rows have the default."""
    gap = (F.unix_micros(order) - F.unix_micros(F.lag(order).over(W.partitionBy(by).orderBy(order)))) / 1e6
    got = rows.withColumn("__gap", gap).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("__gap", F.lit(0.5)).alias("gap"))
    day, gap = 86_400, F.col("gap")
    periods = F.when((F.col("n") < 3) | (gap <= 0), default).when(gap <= day / 4, F.greatest(F.lit(1), F.round(365.25 * day / gap).cast("int")))
    periods = periods.when(gap <= 3 * day, default).when(gap <= 10 * day, 52).when(gap <= 45 * day, 12).when(gap <= 130 * day, 4).otherwise(1)
    return got.select(by, periods.cast("int").alias("periods"))
