"""Registered queries over point-in-time views, exact numbers and trade results, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .operators import gate, pit, trades
from .sources import derived

AS_OF = "1996-06-01"


@query("view_last_five", f"SELECT symbol, ts, available_at, close FROM bars WHERE available_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5", "close", "ts available_at")
def _(spark, sf_dir):
    return pit.PointInTimeView(derived.bars(spark, sf_dir), AS_OF).tail(5).select("symbol", "ts", "available_at", "close")


@query("decimal_notional", "SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, CAST(round_even(CAST(CAST(close * 0.125 AS VARCHAR) AS DECIMAL(38,18)), 3) AS DECIMAL(20,3)) AS eighth FROM bars")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), gate.to_decimal(F.col("close") * 0.125, 3).alias("eighth"))


#: Fills of the queries below: a signed number of units at each bar's close that follows from its volume and day.
_FILLS = "(SELECT symbol, ts, 0 AS seq, CAST((CAST(volume AS BIGINT) * 7 + day(ts)) % 9 - 4 AS DOUBLE) AS q, close AS price FROM bars WHERE (CAST(volume AS BIGINT) * 7 + day(ts)) % 9 <> 4)"


def _fills(spark, sf_dir):
    quantity = (F.col("volume").cast("long") * 7 + F.day("ts")) % 9 - 4
    return derived.bars(spark, sf_dir).select("symbol", "ts", F.lit(0).alias("seq"), quantity.cast("double").alias("quantity"), F.col("close").alias("price"))


_ROUND_TRIPS = f"""WITH f AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM {_FILLS}),
    g AS (SELECT *, CASE WHEN held * q < 0 THEN least(abs(held), abs(q)) ELSE 0 END AS c FROM f),
    h AS (SELECT *, abs(q) - c AS o, sum(c) OVER w AS c1, sum(abs(q) - c) OVER w AS o1 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  SELECT a.symbol, CAST(sign(a.q) AS INTEGER) AS side, least(a.o1, b.c1) - greatest(a.o1 - a.o, b.c1 - b.c) AS quantity, a.ts AS opened, a.price AS open_price, b.ts AS closed, b.price AS close_price,
    sign(a.q) * (b.price - a.price) * (least(a.o1, b.c1) - greatest(a.o1 - a.o, b.c1 - b.c)) AS pnl
  FROM h a JOIN h b ON a.symbol = b.symbol AND a.o > 0 AND b.c > 0 AND a.o1 > b.c1 - b.c AND b.c1 > a.o1 - a.o"""


@query("fifo_round_trips", _ROUND_TRIPS, "quantity open_price close_price pnl", "opened closed")
def _(spark, sf_dir):
    return trades.round_trips(_fills(spark, sf_dir))


_BOOK = f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM {_FILLS}),
    s AS (SELECT symbol, i, q AS held, price AS cost, 0.0::DOUBLE AS realised FROM f WHERE i = 1
      UNION ALL SELECT f.symbol, f.i, s.held + f.q,
        CASE WHEN s.held * f.q >= 0 THEN (s.cost * abs(s.held) + f.price * abs(f.q)) / abs(s.held + f.q) WHEN s.held * (s.held + f.q) < 0 THEN f.price WHEN s.held + f.q = 0 THEN 0.0 ELSE s.cost END,
        CASE WHEN s.held * f.q < 0 THEN least(abs(f.q), abs(s.held)) * (f.price - s.cost) * sign(s.held) ELSE 0.0 END
      FROM s JOIN f ON f.symbol = s.symbol AND f.i = s.i + 1)"""


@query("trade_results", f"""SELECT symbol, count(*) AS n_trades, avg(CAST(realised > 0 AS DOUBLE)) AS trade_win_rate,
    sum(CASE WHEN realised > 0 THEN realised ELSE 0 END) / -sum(CASE WHEN realised < 0 THEN realised END) AS trade_profit_factor FROM ({_BOOK} SELECT * FROM s) GROUP BY symbol""", "trade_win_rate trade_profit_factor")  # fmt: skip
def _(spark, sf_dir):
    return trades.trade_metrics(trades.fill_results(_fills(spark, sf_dir)))
