"""Risk measures and statistics of return series."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import causal as c

LEAST = 20


def value_at_risk(returns: DataFrame, by: str = "symbol", confidence: float = 0.95) -> DataFrame:
    """Historical, normal and Cornish-Fisher VaR and historical CVaR per group; losses are negative."""
    rows = returns.where("r is not null")
    z = NormalDist().inv_cdf(1 - confidence)
    s, k = F.col("skew"), F.col("kurt")
    got = rows.groupBy(by).agg(F.count("r").alias("n"), F.percentile("r", F.lit(1 - confidence)).alias("historical"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt")).where(F.col("n") >= LEAST)
    wide = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s**2 / 36
    got = got.select(by, "n", "historical", (F.col("mean") + z * F.col("sd")).alias("parametric"), (F.col("mean") + wide * F.col("sd")).alias("cornish_fisher"))
    tail = rows.join(got.select(by, "historical"), by).where("r <= historical").groupBy(by).agg(F.avg("r").alias("cvar"))
    return got.join(tail, by, "left").withColumn("cvar", F.coalesce("cvar", "historical"))


def rolling_var(r: Column, window: int = 252, confidence: float = 0.95, method: str = "historical") -> Column:
    """Value at risk of the last `window` returns, this bar's included; null until there are so many, and for windows of fewer than 20."""
    w, z = c.trailing(window), NormalDist().inv_cdf(1 - confidence)
    if method == "historical":
        value = F.percentile(r, F.lit(1 - confidence)).over(w)
    elif method in ("parametric", "cornish_fisher"):
        s, k = F.skewness(r).over(w), F.kurtosis(r).over(w)
        wide = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s**2 / 36
        value = F.avg(r).over(w) + (F.lit(z) if method == "parametric" else wide) * F.stddev_samp(r).over(w)
    else:
        raise ValueError(f"unknown method {method}")
    return c.full(r, window, value if window >= LEAST else F.lit(None).cast("double"))


def trailing_volatility(bars: DataFrame, lookback: int = 63, price: str = "adj_close", inclusive: bool = True, periods: int | None = None, least: int = LEAST) -> DataFrame:
    """symbol, ts, sigma: deviation of the log returns among the last `lookback` bars, this bar's included or not; a year's with `periods`.

    Fewer than `least` returns, and prices that never move, give null. What sizes an order that is filled at a bar must
    not include that bar.
    """
    returns = bars.select("symbol", "ts", c.log_return(F.col(price)).alias("__r"))
    last = 0 if inclusive else -1
    w = c.by_symbol().rowsBetween(last - lookback + 1, last)
    sigma = F.when((F.count("__r").over(w) >= least) & (F.stddev_samp("__r").over(w) > 0), F.stddev_samp("__r").over(w))
    return returns.select("symbol", "ts", (sigma * (periods**0.5 if periods else 1.0)).alias("sigma"))


def var_breach_rate(bars: DataFrame, window: int = 63, confidence: float = 0.95) -> DataFrame:
    """Share of returns below the VaR that was known one bar before."""
    rows = bars.select("symbol", "ts", c.pct_change(F.col("adj_close")).alias("r"))
    rows = rows.withColumn("var", rolling_var(F.col("r"), window, confidence))
    rows = rows.withColumn("before", c.lag(F.col("var"), 1)).where("before is not null and r is not null")
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("r") < F.col("before")).cast("double")).alias("breach_rate"))


def describe(returns: DataFrame, by: str = "symbol") -> DataFrame:
    """Moments, quantiles and the Jarque-Bera test per group."""
    n, s, k = F.count("r"), F.skewness("r"), F.kurtosis("r")
    jb = n / 6 * (s**2 + k**2 / 4)
    q = lambda p: F.percentile("r", F.lit(p))
    return returns.where("r is not null").groupBy(by).agg(
        n.alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"),
        s.alias("skew"), k.alias("kurtosis"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_p"), F.avg((F.col("r") > 0).cast("double")).alias("positive"),
    )


def pairwise(returns: DataFrame, periods: int = 252) -> DataFrame:
    """Covariance (annualised) and correlation of every pair of symbols over their joint dates."""
    a, b = returns.select("ts", F.col("symbol").alias("a"), F.col("r").alias("x")), returns.select("ts", F.col("symbol").alias("b"), F.col("r").alias("y"))
    both = a.join(b, "ts").where("a <= b and x is not null and y is not null")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.covar_samp("x", "y") * periods).alias("covariance"), F.corr("x", "y").alias("correlation"))


def autocorrelation(returns: DataFrame, lags: int = 5, by: str = "symbol") -> DataFrame:
    """Autocorrelation per lag with the Ljung-Box statistic up to it."""
    w = W.partitionBy(by).orderBy("ts")
    rows = returns.where("r is not null").withColumn("e", F.col("r") - F.avg("r").over(W.partitionBy(by)))
    rows = rows.select(by, "e", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)))
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") ** 2).alias("ss"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    rho = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(f"s{k}", "ss").alias("acf")) for k in range(1, lags + 1))))
    long = got.select(by, "n", rho.alias("x")).select(by, "n", "x.*")
    q = F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag"))).over(W.partitionBy(by).orderBy("lag").rowsBetween(W.unboundedPreceding, 0))
    return long.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * q)


def inverse_volatility(returns: DataFrame) -> DataFrame:
    """Weights in proportion to one over the volatility."""
    got = returns.where("r is not null").groupBy("symbol").agg(F.stddev_samp("r").alias("sd")).where("sd > 0")
    return got.select("symbol", (1 / F.col("sd") / F.sum(1 / F.col("sd")).over(W.partitionBy())).alias("weight"))


def rank_pairwise(returns: DataFrame) -> DataFrame:
    """Spearman correlation of every pair of symbols over their joint dates, ties by average ranks."""
    a, b = returns.select("ts", F.col("symbol").alias("a"), F.col("r").alias("x")), returns.select("ts", F.col("symbol").alias("b"), F.col("r").alias("y"))
    both = a.join(b, "ts").where("a <= b and x is not null and y is not null")
    rank = lambda v: F.rank().over(W.partitionBy("a", "b").orderBy(v)) + (F.count(F.lit(1)).over(W.partitionBy("a", "b", v)) - 1) / 2
    ranked = both.select("a", "b", rank("x").alias("rx"), rank("y").alias("ry"))
    return ranked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman"))


def volatility_clustering(returns: DataFrame, lags: int = 5, by: str = "symbol") -> DataFrame:
    """Autocorrelation and Ljung-Box statistic of the squared returns."""
    return autocorrelation(returns.withColumn("r", F.col("r") ** 2), lags, by)


def summarise(returns: DataFrame, by: str = "symbol", periods: int = 252) -> DataFrame:
    """Volatility, downside volatility, worst and best return beside the values at risk, per group of 20 returns or more."""
    r = F.col("r")
    got = returns.where("r is not null").groupBy(by).agg(
        (F.stddev_samp(r) * periods**0.5).alias("volatility"), (F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(F.lit(0.0)))) * periods**0.5).alias("downside_volatility"),
        F.min(r).alias("worst"), F.max(r).alias("best"),
    )
    return value_at_risk(returns, by).join(got, by)
