"""Results of trades: what each fill realises, and round trips of first-in-first-out matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def round_trips(fills: DataFrame, by: str = "symbol") -> DataFrame:
    """by, side (1 long, -1 short), quantity, opened, open_price, closed, close_price, pnl: units opened first are closed first.

    fills (by, ts, seq, quantity, price): signed quantities in the order of (ts, seq). A fill against the position closes
    it and opens the rest on the other side. The k-th unit closed is the k-th unit opened, since both counts agree whenever
    the position is flat: so running counts of opened and closed units, put in one order, cut each other into stretches
    that one opening and one closing fill share. No fill is joined with another. Zero and null quantities are no fills;
    units still open give no row.
    """
    order = W.partitionBy(by).orderBy("ts", "seq")
    q = F.col("quantity").cast("double")
    rows = fills.where(q.isNotNull() & (q != 0)).select(by, "ts", "seq", q.alias("q"), F.col("price").cast("double").alias("price"))
    rows = rows.withColumn("before", F.coalesce(F.sum("q").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    against = F.col("before") * F.col("q") < 0
    closes = F.when(against, F.least(F.abs("before"), F.abs("q"))).otherwise(0.0)
    rows = rows.withColumn("closes", closes).withColumn("opens", F.abs("q") - F.col("closes"))
    until = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"closed_to": F.sum("closes").over(until), "opened_to": F.sum("opens").over(until)})
    fill = F.struct(F.col("ts").alias("at"), "price", F.signum("q").alias("side"))
    ends = rows.select(by, F.explode(F.array(
        F.when(F.col("opens") > 0, F.struct(F.col("opened_to").alias("upto"), fill.alias("o"), F.lit(None).cast(rows.select(fill.alias("f")).schema["f"].dataType).alias("c"))),
        F.when(F.col("closes") > 0, F.struct(F.col("closed_to").alias("upto"), F.lit(None).cast(rows.select(fill.alias("f")).schema["f"].dataType).alias("o"), fill.alias("c"))),
    )).alias("x")).where("x IS NOT NULL").select(by, "x.*")
    both = ends.groupBy(by, "upto").agg(F.first("o", ignorenulls=True).alias("o"), F.first("c", ignorenulls=True).alias("c"))
    along = W.partitionBy(by).orderBy("upto")
    ahead = along.rowsBetween(0, W.unboundedFollowing)
    cut = both.withColumns({"quantity": F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0.0)), "o": F.first("o", ignorenulls=True).over(ahead), "c": F.first("c", ignorenulls=True).over(ahead)})
    cut = cut.where("o IS NOT NULL AND c IS NOT NULL")
    pnl = F.col("o.side") * (F.col("c.price") - F.col("o.price")) * F.col("quantity")
    return cut.select(by, F.col("o.side").cast("int").alias("side"), "quantity", F.col("o.at").alias("opened"), F.col("o.price").alias("open_price"), F.col("c.at").alias("closed"), F.col("c.price").alias("close_price"), pnl.alias("pnl"))


def fill_results(fills: DataFrame, by: str = "symbol") -> DataFrame:
    """by, ts, seq, quantity, price, realised, position, average_cost: what each fill realises against the average cost of the position.

    Opening more moves the average cost, closing leaves it, and a fill through zero starts anew at its own price. A table
    function sees the fills of each group in order and holds its position and cost alone.
    """

    class Book:
        def __init__(self):
            self.held, self.cost = 0.0, 0.0

        def eval(self, row):
            quantity, price, realised = float(row["quantity"]), float(row["price"]), 0.0
            if self.held * quantity < 0:
                closing = min(abs(quantity), abs(self.held))
                realised = closing * (price - self.cost) * (1 if self.held > 0 else -1)
            after = self.held + quantity
            if self.held * quantity >= 0:
                self.cost = (self.cost * abs(self.held) + price * abs(quantity)) / abs(after)
            elif self.held * after < 0:
                self.cost = price
            elif after == 0:
                self.cost = 0.0
            self.held = after
            yield row["grp"], row["ts"], row["seq"], quantity, price, realised, after, self.cost

    rows = fills.where("quantity IS NOT NULL AND quantity <> 0").select(F.col(by).alias("grp"), "ts", F.col("seq").cast("long").alias("seq"), "quantity", "price")
    kind = rows.schema["grp"].dataType.simpleString()
    book = F.udtf(Book, returnType=f"grp {kind}, ts timestamp, seq long, quantity double, price double, realised double, position double, average_cost double")
    return book(rows.asTable().partitionBy("grp").orderBy("ts", "seq")).withColumnRenamed("grp", by)


def trade_metrics(results: DataFrame, pnl: str = "realised", by: str = "symbol") -> DataFrame:
    """by, n_trades, trade_win_rate, trade_profit_factor (null without a loss) of rows with a result; nulls are none."""
    x: Column = F.col(pnl)
    won, lost = F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))
    return results.where(x.isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n_trades"), F.avg((x > 0).cast("double")).alias("trade_win_rate"), F.try_divide(F.coalesce(won, F.lit(0.0)), lost).alias("trade_profit_factor"))
