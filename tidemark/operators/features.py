"""The feature library: 24 price features and three for each macro series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import causal as c
from .quality import require_columns
from .relational import asof_join


def price_columns(price: str = "adj_close") -> dict[str, Column]:
    """The price features that are plain window expressions."""
    p, r = F.col(price), c.log_return(F.col(price))
    simple = c.pct_change(p)
    found = {f"ret_{n}d": c.pct_change(p, n) for n in (1, 5, 21)}
    found |= {f"mom_{n}d": c.pct_change(p, n) for n in (21, 63, 126, 252)}
    found["mom_252d_skip21"] = F.try_divide(c.lag(p, 21), c.lag(p, 252)) - 1
    found |= {f"vol_{n}d": c.realised_volatility(F.col("__log"), n) for n in (21, 63)}
    found |= {f"downside_vol_{n}d": c.downside_volatility(F.col("__log"), n) for n in (21, 63)}
    found |= {f"price_to_ma_{n}": F.try_divide(p, c.rolling_mean(p, n)) - 1 for n in (20, 50, 200)}
    found["ma_ratio_20_100"] = F.try_divide(c.rolling_mean(p, 20), c.rolling_mean(p, 100)) - 1
    found |= {f"ret_zscore_{n}d": c.rolling_zscore(F.col("__ret"), n) for n in (21, 63)}
    found["volume_zscore_21d"] = c.rolling_zscore(F.col("__volume"), 21)
    found["dollar_volume_ratio_21d"] = F.try_divide(F.col("__dollars"), c.rolling_mean(F.col("__dollars"), 21)) - 1
    found["ret_skew_63d"] = c.rolling_skew(F.col("__ret"), 63)
    found["drawdown_252d"] = c.drawdown(p, 252)
    found["__sources"] = F.struct(r.alias("log"), simple.alias("ret"))
    return found


def price_features(bars: DataFrame, price: str = "adj_close") -> DataFrame:
    """symbol, ts, available_at and the 24 price features; warm-up rows without any feature are dropped. SchemaError without the columns they need."""
    require_columns(bars, ["symbol", "ts", "available_at", "high", "low", "close", "volume", price])
    columns = price_columns(price)
    sources = columns.pop("__sources")
    rows = bars.withColumn("__s", sources).select(
        "*",
        F.col("__s.log").alias("__log"),
        F.col("__s.ret").alias("__ret"),
        F.when(F.col("volume") >= 0, F.log1p("volume")).alias("__volume"),
        (F.col("volume") * F.col("close")).alias("__dollars"),
    )
    # windows by symbol first: the exponential means join at the end
    made = rows.withColumns(columns)
    made = c.rsi_and_range(made.select("symbol", "ts", "available_at", "high", "low", "close", F.col(price).alias("__price"), *columns), "__price", 14, "rsi_14", "__atr")
    made = made.withColumn("atr_14_normalised", F.try_divide("__atr", "close"))
    names = [*columns, "rsi_14", "atr_14_normalised"]
    made = made.select("symbol", "ts", "available_at", *names)
    return made.dropna("all", subset=names)


def macro_features(prices: DataFrame, macro: DataFrame, codes: list[str]) -> DataFrame:
    """Level, 21-bar change and 252-bar z-score of the latest published value of each series."""
    rows = prices.select("symbol", "ts", "available_at")
    for code in codes:
        rows = asof_join(rows, macro.where(F.col("code") == code), "value", f"macro_{code}_level")
    extra = {}
    for code in codes:
        level = F.col(f"macro_{code}_level")
        extra[f"macro_{code}_chg_21d"] = level - c.lag(level, 21)
        extra[f"macro_{code}_z_252d"] = c.rolling_zscore(level, 252)
    return rows.select("*", *(v.alias(k) for k, v in extra.items()))
