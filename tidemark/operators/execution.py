"""Execution of orders at a later bar, and the book that target weights lead to: orders, fills and equity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .backtest import CostModel, in_lots

#: Why an order is not filled.
REJECTIONS = ("no_later_bar", "non_positive_reference_price", "exceeds_max_participation", "limit_not_reached")


def _later_bars(orders: DataFrame, bars: DataFrame, bucket: str) -> DataFrame:
    """bars with since (the bar before, exclusive end of what they do not execute) and a row for each bucket from there to the bar."""
    first = orders.agg(F.min("decision_ts").alias("__first"))  # one row
    before = F.lag("ts").over(W.partitionBy("symbol").orderBy("ts"))
    rows = bars.where("ts is not null").withColumn("__since", before).join(F.broadcast(first))
    rows = rows.withColumn("__since", F.coalesce("__since", F.least("__first", "ts")))
    start, stop = F.greatest(F.date_trunc(bucket, "__since"), F.date_trunc(bucket, "__first")), F.date_trunc(bucket, "ts")
    buckets = F.when(start <= stop, F.sequence(start, stop, F.expr(f"INTERVAL 1 {bucket}")))
    return rows.withColumn("__bucket", F.explode(buckets)).drop("__first")


def executed(orders: DataFrame, bars: DataFrame, at: str = "open", costs: CostModel | None = None, participation: float | None = 0.25, usual: float = 0.02, bucket: str = "day") -> DataFrame:
    """orders with status, execution_ts, reference, fill_price, commission and slippage (in money; null where not filled).

    orders has symbol, decision_ts and a signed quantity, and perhaps limit_price (null: at the market) and sigma (a
    day's volatility for the cost model; `usual` where unknown). An order meets its symbol's first bar strictly after the
    decision, at that bar's open or close. status is filled or one of REJECTIONS; a missing volume limits nothing. A
    limit order needs the bar's range to reach its limit and fills at the better of limit and reference. Bars of one
    symbol and instant must not repeat.

    Orders and bars meet by symbol and bucket, a bar once for each bucket since the bar before it; take a bucket near the
    bars' spacing. No window runs over orders, so a symbol with most of them is many tasks.
    """
    if at not in ("open", "close"):
        raise ValueError("orders fill at the open or the close of a later bar")
    model = CostModel() if costs is None else costs
    absent = F.lit(None).cast("double")
    rows = orders
    for name in ("limit_price", "sigma"):
        rows = rows if name in orders.columns else rows.withColumn(name, absent)
    later = _later_bars(orders, bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), bucket)
    later = later.select("symbol", "__bucket", "__since", F.col("ts").alias("execution_ts"), F.struct(F.col(at).alias("price"), "high", "low", F.nanvl("volume", absent).alias("volume")).alias("__bar"))
    rows = rows.withColumn("__bucket", F.date_trunc(bucket, "decision_ts"))
    inside = (F.col("o.decision_ts") >= F.col("b.__since")) & (F.col("o.decision_ts") < F.col("b.execution_ts"))
    met = rows.alias("o").join(later.alias("b"), (F.col("o.symbol") == F.col("b.symbol")) & (F.col("o.__bucket") == F.col("b.__bucket")) & inside, "left")
    met = met.select("o.*", "b.execution_ts", "b.__bar").drop("__bucket")

    quantity, limit, price, volume = F.col("quantity"), F.col("limit_price"), F.col("__bar.price"), F.col("__bar.volume")
    buy = quantity > 0
    reached = F.when(buy, F.col("__bar.low") <= limit).otherwise(F.col("__bar.high") >= limit)
    status = F.when(F.col("execution_ts").isNull(), REJECTIONS[0])
    status = status.when(~F.coalesce((price > 0) & ~F.isnan(price), F.lit(False)), REJECTIONS[1])
    if participation is not None:
        status = status.when((volume > 0) & (F.abs(quantity) > participation * volume), REJECTIONS[2])
    status = status.when(limit.isNotNull() & ~F.coalesce(reached, F.lit(False)), REJECTIONS[3]).otherwise("filled")
    better = F.when(limit.isNull(), price).when(buy, F.least(price, limit)).otherwise(F.greatest(price, limit))
    done = met.withColumn("status", status).withColumn("reference", F.when(F.col("status") == "filled", better))
    side, sigma = F.signum("quantity"), F.coalesce("sigma", F.lit(usual))
    commission, slippage = model.costs(quantity, F.col("reference"), volume, sigma)
    filled = F.col("status") == "filled"
    done = done.withColumn("fill_price", F.when(filled, model.slippage(F.col("reference"), side, quantity, volume, sigma)))
    done = done.withColumns({"commission": F.when(filled, commission), "slippage": F.when(filled, slippage)})
    return done.drop("__bar", *(n for n in ("limit_price", "sigma") if n not in orders.columns))


def book(targets: DataFrame, bars: DataFrame, equity: float = 100_000.0, at: str = "open", costs: CostModel | None = None, lot: int = 1, bucket: str = "day") -> dict[str, DataFrame]:
    """orders, fills and equity of target weights (symbol, ts, weight), each sized on the equity at the start.

    A target is a number of whole lots at its bar's close; its order is what it differs from the symbol's last target
    that could be filled, so a target without a later bar, or before one without a positive price, changes nothing.
    orders: symbol, decision_ts, quantity (orders of nothing are left out), status. fills: those filled, with their
    execution. equity: ts, cash, held (positions at their last close) and equity at every instant of a bar.
    """
    sized = targets.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"]).where("close > 0")
    wanted = sized.select("symbol", F.col("ts").alias("decision_ts"), in_lots(F.col("weight") * equity / F.col("close"), lot).cast("double").alias("__target"), F.lit(1.0).alias("quantity"))
    # whether a target can be filled depends on its bar alone, so that is found first and the changes after it
    possible = executed(wanted, bars, at, None, None, bucket=bucket).select("symbol", "decision_ts", "__target", "status")
    w = W.partitionBy("symbol").orderBy("decision_ts").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("status") == "filled", F.col("__target")), ignorenulls=True).over(w), F.lit(0.0))
    orders = possible.select("symbol", "decision_ts", (F.col("__target") - before).alias("quantity"), "status").where("quantity <> 0")
    fills = executed(orders.where("status = 'filled'").drop("status"), bars, at, costs, None, bucket=bucket)

    flows = fills.groupBy("symbol", F.col("execution_ts").alias("ts")).agg(
        F.sum("quantity").alias("q"), F.sum(-F.col("quantity") * F.col("fill_price") - F.col("commission")).alias("paid")
    )
    marked = bars.select("symbol", "ts", "close").join(flows, ["symbol", "ts"], "left").fillna(0.0, ["q", "paid"])
    each = W.partitionBy("symbol").orderBy("ts")
    held = F.sum("q").over(each.rowsBetween(W.unboundedPreceding, 0)) * F.col("close")
    marked = marked.select("symbol", "ts", "paid", held.alias("held")).withColumn("change", F.col("held") - F.coalesce(F.lag("held").over(each), F.lit(0.0)))
    # one row for each instant of the timeline, however many symbols there are
    daily = marked.groupBy("ts").agg(F.sum("paid").alias("paid"), F.sum("change").alias("change"))
    until = W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    curve = daily.select("ts", (F.lit(equity) + F.sum("paid").over(until)).alias("cash"), F.sum("change").over(until).alias("held"))
    return {"orders": orders, "fills": fills, "equity": curve.withColumn("equity", F.col("cash") + F.col("held"))}
