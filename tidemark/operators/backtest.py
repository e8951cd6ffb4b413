"""Strategy targets, costs, next-bar fills and performance metrics as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import causal as c

YEAR_DAYS = 365.25


def ma_crossover_targets(bars: DataFrame, fast: int = 20, slow: int = 100, allow_short: bool = False) -> DataFrame:
    """Equal shares of the symbols seen at each instant: long above the slow mean, else flat or short."""
    p = F.col("adj_close")
    rows = bars.select("symbol", "ts", c.rolling_mean(p, fast).alias("fast"), c.rolling_mean(p, slow).alias("slow"))
    share = 1 / F.count(F.lit(1)).over(W.partitionBy("ts"))
    other = -share if allow_short else F.lit(0.0)
    return rows.withColumn("weight", F.when(F.col("fast") > F.col("slow"), share).otherwise(other)).where("slow is not null").select("symbol", "ts", "weight")


def momentum_targets(bars: DataFrame, lookback: int = 126, allow_short: bool = False) -> DataFrame:
    rows = bars.select("symbol", "ts", c.pct_change(F.col("adj_close"), lookback).alias("past"))
    share = 1 / F.count(F.lit(1)).over(W.partitionBy("ts"))
    weight = F.when(F.col("past") > 0, share).when(F.col("past") < 0, -share if allow_short else F.lit(0.0)).otherwise(F.lit(0.0))
    return rows.withColumn("weight", weight).where("past is not null").select("symbol", "ts", "weight")


def buy_and_hold_targets(bars: DataFrame) -> DataFrame:
    """The same share for every symbol, at each of its instants."""
    symbols = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("__n"))
    return bars.join(F.broadcast(symbols)).select("symbol", "ts", (1 / F.col("__n")).alias("weight"))


def prediction_targets(preds: DataFrame, positions: int = 2, threshold: float = 0.0, leverage: float = 1.0) -> DataFrame:
    """The `positions` best forecasts above the threshold share the book; everything else has weight zero."""
    order = W.partitionBy("ts").orderBy(F.desc("long"), F.desc("y_pred"), "symbol")
    rows = preds.withColumn("long", (F.col("y_pred") > threshold).cast("int")).withColumn("rank", F.row_number().over(order))
    chosen = (F.col("long") == 1) & (F.col("rank") <= positions)
    held = F.sum(chosen.cast("int")).over(W.partitionBy("ts"))
    return rows.select("symbol", "ts", F.when(chosen, leverage / held).otherwise(F.lit(0.0)).alias("weight"))


def next_open_fills(targets: DataFrame, bars: DataFrame) -> DataFrame:
    """A target decided at a bar fills at the symbol's next open, never at its own bar."""
    w = W.partitionBy("symbol").orderBy("ts")
    ahead = bars.select("symbol", "ts", F.lead("ts").over(w).alias("fill_ts"), F.lead("open").over(w).alias("fill_price"))
    return targets.join(ahead, ["symbol", "ts"]).where("fill_price > 0")


def per_share_commission(quantity: Column, notional: Column, rate: float = 0.005, least: float = 1.0, cap: float = 0.01) -> Column:
    """A fee per share with a minimum for the order, at most a share of the notional; without a notional there is no cap."""
    fee, most = F.greatest(rate * F.abs(quantity), F.lit(least)), cap * F.abs(notional)
    return F.when(most > 0, F.least(fee, most)).otherwise(fee)


def percent_commission(notional: Column, bps: float = 5.0, least: float = 0.0) -> Column:
    return F.greatest(F.abs(notional) * bps / 10_000, F.lit(least))


def fixed_slippage(price: Column, side: Column, bps: float = 5.0) -> Column:
    """Buyers pay up, sellers receive less."""
    return price * (1 + side * bps / 10_000)


def impact_slippage(price: Column, side: Column, quantity: Column, volume: Column, sigma: Column, coefficient: float = 1.0, half_spread: float = 2.5, usual: float = 0.02, most: float = 0.25) -> Column:
    """Half the spread (basis points) and an impact of coefficient * sigma * sqrt(share of the bar's volume, at most `most`).

    An unknown or non-positive sigma (a day) counts as `usual`; without a volume only the half spread is paid.
    """
    sigma = F.when(sigma > 0, sigma).otherwise(F.lit(usual))
    share = F.when(volume > 0, F.least(F.abs(quantity) / volume, F.lit(most)))
    return price * (1 + side * (half_spread / 10_000 + F.coalesce(coefficient * sigma * F.sqrt(share), F.lit(0.0))))


@dataclass(frozen=True)
class CostModel:
    """What a trade costs: commission(quantity, notional) and slippage(price, side, quantity, volume, sigma) -> fill price; any columns will do."""

    commission: Callable[[Column, Column], Column] = lambda quantity, notional: F.lit(0.0)
    slippage: Callable[..., Column] = lambda price, side, quantity, volume, sigma: price

    def costs(self, quantity: Column, price: Column, volume: Column, sigma: Column) -> tuple[Column, Column]:
        """Commission and slippage in money of trading a signed quantity at a reference price; nothing for no quantity."""
        traded, side = F.coalesce(quantity != 0, F.lit(False)), F.signum(quantity)
        filled = self.slippage(price, side, quantity, volume, sigma)
        fee = self.commission(quantity, quantity * filled)
        return F.when(traded, fee).otherwise(0.0), F.when(traded, F.abs(quantity) * F.abs(filled - price)).otherwise(0.0)


#: The three cost scenarios of a study.
COSTS = {
    "frictionless": CostModel(),
    "realistic": CostModel(lambda q, n: per_share_commission(q, n, 0.005), lambda p, side, q, v, s: fixed_slippage(p, side, 5.0)),
    "pessimistic": CostModel(lambda q, n: per_share_commission(q, n, 0.01), lambda p, side, q, v, s: impact_slippage(p, side, q, v, s, 1.0, 5.0)),
}


def sized_orders(targets: DataFrame, bars: DataFrame, equity: float = 100_000.0, most_weight: float = 1.0, participation: float | None = 0.1, lot: int = 1, size: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Units in whole lots for each target weight, at most a share of the bar's volume where it has one.

    A missing or zero volume sets no limit, nor does participation None. A price that is not positive is an error. `size`
    may stand in for weight * equity / price: a function of the limited weight and the price.
    """
    rows = targets.join(bars.select("symbol", "ts", "close", "volume"), ["symbol", "ts"])
    weight = F.greatest(F.lit(-most_weight), F.least(F.lit(most_weight), F.col("weight")))
    price = F.when(F.col("close") > 0, F.col("close")).otherwise(F.raise_error(F.concat(F.lit("no positive price of "), "symbol")).cast("double"))
    raw = weight * equity / price if size is None else size(weight, price)
    if participation is not None:
        limit = participation * F.col("volume")
        raw = F.when(F.col("volume") > 0, F.greatest(-limit, F.least(limit, raw))).otherwise(raw)
    return rows.select("symbol", "ts", "weight", in_lots(raw, lot).alias("quantity"))


def rebalance_dates(bars: DataFrame, frequency: str = "month") -> DataFrame:
    """The first instant of each period on the joint timeline."""
    return bars.groupBy(F.date_trunc(frequency, "ts").alias("period")).agg(F.min("ts").alias("ts"))


def equity_metrics(curve: DataFrame, run: str = "run", periods: int = 252) -> DataFrame:
    """Performance per run of an equity curve (run, ts, equity)."""
    w = W.partitionBy(run).orderBy("ts")
    rows = curve.withColumn("r", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    rows = rows.withColumn("dd", F.try_divide("equity", F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))) - 1)
    r = F.col("r")
    years = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / (YEAR_DAYS * 86_400)
    growth = F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts"))
    got = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), (growth - 1).alias("total_return"), (F.pow(growth, F.try_divide(F.lit(1.0), F.nullif(years, F.lit(0.0)))) - 1).alias("cagr"),
        (F.stddev_samp(r) * periods**0.5).alias("volatility"), (F.try_divide(F.avg(r), F.when(F.stddev_samp(r) > 1e-12, F.stddev_samp(r))) * periods**0.5).alias("sharpe"),
        (F.try_divide(F.avg(r), F.sqrt(F.avg(F.when(r < 0, r * r)))) * periods**0.5).alias("sortino"), F.min("dd").alias("max_drawdown"),
        F.avg(F.when(F.abs(r) > 1e-12, (r > 0).cast("double"))).alias("win_rate"), F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"),
    )
    return got.withColumn("calmar", F.try_divide("cagr", F.nullif(F.abs("max_drawdown"), F.lit(0.0))))


def benchmark_stats(returns: DataFrame, run: str = "symbol", periods: int = 252) -> DataFrame:
    """beta, tracking error and information ratio of r against b (columns run, r, b); needs three joint rows."""
    rows = returns.where("r is not null and b is not null")
    active = F.col("r") - F.col("b")
    got = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("r", "b"), F.nullif(F.var_samp("b"), F.lit(0.0))).alias("beta"),
        (F.stddev_samp(active) * periods**0.5).alias("tracking_error"), (F.try_divide(F.avg(active), F.nullif(F.stddev_samp(active), F.lit(0.0))) * periods**0.5).alias("information_ratio"),
    )
    return got.where("n >= 3")


def drawdown_episodes(curve: DataFrame, run: str = "run", k: int = 5) -> DataFrame:
    """The k deepest episodes below a running peak per run: start, trough_ts, end, depth, length, underwater, place.

    An episode ends with, and its length counts, the row that is back at the peak; the last one may still be open.
    underwater counts the rows below the peak alone. Runs of fewer than three rows have no episodes.
    """
    w = W.partitionBy(run).orderBy("ts")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = curve.where("equity is not null").withColumn("peak", F.max("equity").over(so_far)).withColumn("rows", F.count(F.lit(1)).over(W.partitionBy(run))).where("rows >= 3")
    rows = rows.withColumn("under", F.col("equity") < F.col("peak")).withColumn("dd", F.try_divide("equity", "peak") - 1)
    # rows at a peak before this one: the same for all rows of an episode and for the row that ends it
    at_peak = (~F.col("under")).cast("int")
    rows = rows.withColumn("island", F.sum(at_peak).over(so_far) - at_peak)
    got = rows.groupBy(run, "island").agg(
        F.min(F.when(F.col("under"), F.col("ts"))).alias("start"), F.min(F.when(F.col("under"), F.struct("dd", "ts"))).alias("trough"), F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("length"), F.count_if("under").alias("underwater"),
    ).where("underwater > 0")
    got = got.select(run, "start", F.col("trough.ts").alias("trough_ts"), "end", F.col("trough.dd").alias("depth"), "length", "underwater")
    return got.withColumn("place", F.row_number().over(W.partitionBy(run).orderBy("depth", "start"))).where(F.col("place") <= k)


def long_short_targets(preds: DataFrame, long_above: float = 0.0, short_below: float | None = None, positions: int | None = None, leverage: float = 1.0) -> DataFrame:
    """Forecasts above one threshold are bought and those below the other sold, in equal shares; all else is flat.

    With `positions`, at most so many on each side: the highest of the bought and the lowest of the sold, ties by symbol.
    Without short_below nothing is sold. Forecasts that are null or not finite give no target.
    """
    y = F.col("y_pred")
    rows = preds.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    side = F.when(y > long_above, 1)
    side = (side if short_below is None else side.when(y < short_below, -1)).otherwise(0)
    rows = rows.withColumn("side", side)
    chosen = F.col("side") != 0
    if positions is not None:
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("ts", "side").orderBy(F.desc(F.abs("side")), F.desc(F.col("side") * y), "symbol")))
        chosen = chosen & (F.col("rank") <= positions)
    held = F.sum(chosen.cast("int")).over(W.partitionBy("ts"))
    return rows.select("symbol", "ts", F.when(chosen, leverage * F.col("side") / held).otherwise(F.lit(0.0)).alias("weight"))


def volatility_scaled(targets: DataFrame, volatility: DataFrame, target: float = 0.1, most: float = 2.0, fallback: float = 0.2) -> DataFrame:
    """targets with each weight scaled to a target volatility, at most `most` on either side.

    volatility has symbol, ts, sigma (a year), known at the instant of the target; where it is missing or nearly zero,
    the fallback stands in.
    """
    rows = targets.join(volatility.select("symbol", "ts", "sigma"), ["symbol", "ts"], "left")
    sigma = F.when(F.col("sigma") > 1e-8, F.col("sigma")).otherwise(F.lit(fallback))
    return rows.select("symbol", "ts", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("weight") * target / sigma)).alias("weight"))


def in_lots(quantity: Column, lot: int = 100) -> Column:
    """Whole lots, rounded towards zero."""
    return (F.signum(quantity) * F.floor(F.abs(quantity) / lot) * lot).cast("long")


def turnover_exposure(targets: DataFrame, periods: int = 252) -> DataFrame:
    """turnover (a year, both sides), gross and net exposure on average over the instants of weights (symbol, ts, weight)."""
    change = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(W.partitionBy("symbol").orderBy("ts")), F.lit(0.0)))
    daily = targets.withColumn("change", change).groupBy("ts").agg(F.sum("change").alias("change"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    return daily.agg(F.count(F.lit(1)).alias("n"), (F.avg("change") * periods).alias("turnover"), F.avg("gross").alias("gross"), F.avg("net").alias("net"))


def trade_costs(fills: DataFrame, scenario: str | CostModel = "realistic", by: str = "symbol") -> DataFrame:
    """trades, notional, commission and slippage per group of fills (quantity, price, and perhaps volume and sigma) under a cost scenario."""
    model = COSTS[scenario] if isinstance(scenario, str) else scenario
    known = lambda c: F.col(c) if c in fills.columns else F.lit(None).cast("double")
    commission, slippage = model.costs(F.col("quantity"), F.col("price"), known("volume"), known("sigma"))
    notional = F.abs(F.col("quantity") * F.col("price"))
    return fills.groupBy(by).agg(F.count_if(F.col("quantity") != 0).alias("trades"), F.sum(notional).alias("notional"), F.sum(commission).alias("commission"), F.sum(slippage).alias("slippage"))


def normalised_curves(curve: DataFrame, run: str = "run") -> DataFrame:
    """curve with equity as a multiple of each run's first value that is not zero or null."""
    first = curve.where("equity is not null and equity <> 0").groupBy(run).agg(F.min_by("equity", "ts").alias("__first"))
    return curve.join(first, run).withColumn("equity", F.col("equity") / F.col("__first")).drop("__first")


def benchmark_alpha(returns: DataFrame, run: str = "symbol", periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """n, beta, alpha (a year) and excess Sharpe ratio of r against b; needs three joint rows."""
    rf = risk_free / periods
    got = returns.where("r is not null and b is not null").groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("r", "b"), F.nullif(F.var_samp("b"), F.lit(0.0))).alias("beta"),
        F.avg("r").alias("mr"), F.avg("b").alias("mb"), F.stddev_samp("r").alias("sd"),
    ).where("n >= 3")
    alpha = (F.col("mr") - rf - F.col("beta") * (F.col("mb") - rf)) * periods
    return got.select(run, "n", "beta", alpha.alias("alpha"), (F.try_divide(F.col("mr") - rf, F.nullif("sd", F.lit(0.0))) * periods**0.5).alias("sharpe"))


def performance_shape(curve: DataFrame, run: str = "run") -> DataFrame:
    """years, skewness and excess kurtosis (without bias), best and worst return, longest time below the peak in rows, per run."""
    w = W.partitionBy(run).orderBy("ts")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = curve.withColumn("r", F.try_divide("equity", F.lag("equity").over(w)) - 1).withColumn("__under", F.col("equity") < F.max("equity").over(so_far))
    rows = rows.withColumn("__island", F.sum((~F.col("__under")).cast("int")).over(so_far))
    longest = rows.where("__under").groupBy(run, "__island").count().groupBy(run).agg(F.max("count").alias("longest_underwater"))
    n, s, k = F.count("r"), F.skewness("r"), F.kurtosis("r")
    years = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / (YEAR_DAYS * 86_400)
    got = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), years.alias("years"), F.when(n > 2, s * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)).alias("excess_kurtosis"), F.max("r").alias("best"), F.min("r").alias("worst"),
    )
    return got.join(longest, run, "left").fillna(0, ["longest_underwater"])
