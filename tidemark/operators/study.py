"""A study of forecasts against a baseline: accuracy, significance, economics, and the verdict that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import evaluation

#: Cost scenarios in basis points of the traded weight: books of weights have no shares for backtest.COSTS to charge.
SCENARIOS = {"frictionless": 0.0, "realistic": 6.0, "pessimistic": 25.0}


def significance(preds: DataFrame, baseline: str = "zero", horizon: int = 1) -> DataFrame:
    """model, n, lags, mean, statistic, p, p_adjusted of each model's squared loss less the baseline's, by date.

    p_adjusted is Benjamini-Hochberg's over the models; a negative mean favours the model.
    """
    base = preds.where(F.col("model") == baseline).select("symbol", "ts", F.col("y_pred").alias("__base"))
    both = preds.where(F.col("model") != baseline).join(base, ["symbol", "ts"])
    loss = (F.col("y_true") - F.col("y_pred")) ** 2 - (F.col("y_true") - F.col("__base")) ** 2
    daily = both.groupBy("model", "ts").agg(F.avg(loss).alias("d"))
    return evaluation.adjust_pvalues(evaluation.diebold_mariano(daily, horizon, by="model"))


def strategy_returns(preds: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """model, ts, r: equal shares long or short by the forecast's sign, less the cost of the traded weight.

    The first position of a symbol is traded from nothing. y_true is the return of the period that follows ts.
    """
    share = F.signum("y_pred") / F.count(F.lit(1)).over(W.partitionBy("model", "ts"))
    rows = preds.where("y_pred is not null and y_true is not null").withColumn("__w", share)
    before = F.coalesce(F.lag("__w").over(W.partitionBy("model", "symbol").orderBy("ts")), F.lit(0.0))
    net = F.col("__w") * F.col("y_true") - F.abs(F.col("__w") - before) * cost_bps / 10_000
    return rows.withColumn("__net", net).groupBy("model", "ts").agg(F.sum("__net").alias("r"))


def economics(preds: DataFrame, scenarios: dict[str, float] | None = None, periods: int = 252) -> DataFrame:
    """model, scenario, n, mean, sharpe of the strategies, and of buy_and_hold, which holds all symbols alike."""
    hold = preds.select("symbol", "ts", "y_true").distinct().withColumn("model", F.lit("buy_and_hold")).withColumn("y_pred", F.lit(1.0))
    book = preds.select("model", "symbol", "ts", "y_pred", "y_true").unionByName(hold)
    out = None
    for name, bps in (SCENARIOS if scenarios is None else scenarios).items():
        rows = strategy_returns(book, bps).withColumn("scenario", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    sharpe = F.try_divide(F.avg("r"), F.when(F.stddev_samp("r") > 1e-12, F.stddev_samp("r"))) * periods**0.5
    return out.groupBy("model", "scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), sharpe.alias("sharpe"))


def verdict(preds: DataFrame, baselines: tuple[str, ...] = ("zero", "historical_mean", "last_value"), baseline: str = "zero", horizon: int = 1, alpha: float = 0.05) -> DataFrame:
    """One row: models, positive_r2, significant, economic (numbers of models that pass each gate) and the verdict.

    The gates follow each other: an out-of-sample R2 above zero, a significant gain over the baseline, and a Sharpe
    ratio above buy and hold under realistic costs. Baselines never count as models.
    """
    learned = ~F.col("model").isin(*baselines)
    r2 = evaluation.forecast_metrics(preds.where(learned), "model").select("model", "r2_zero")
    gain = significance(preds, baseline, horizon).where(learned).select("model", ((F.col("mean") < 0) & (F.col("p_adjusted") < alpha)).alias("gains"))
    money = economics(preds, {"realistic": SCENARIOS["realistic"]})
    hold = money.where("model = 'buy_and_hold'").select(F.col("sharpe").alias("hold"))
    beats = money.join(F.broadcast(hold)).select("model", (F.col("sharpe") > F.col("hold")).alias("beats"))
    each = r2.join(gain, "model", "left").join(beats, "model", "left")
    got = each.agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.col("r2_zero") > 0).alias("positive_r2"), F.count_if(F.coalesce("gains", F.lit(False))).alias("significant"),
        F.count_if(F.coalesce("gains", F.lit(False)) & F.coalesce("beats", F.lit(False))).alias("economic"),
    )
    said = F.when(F.col("models") == 0, "unanswered").when(F.col("positive_r2") == 0, "no_improvement").when(F.col("significant") == 0, "within_noise")
    return got.withColumn("verdict", said.when(F.col("economic") == 0, "economically_irrelevant").otherwise("provisional_yes"))
