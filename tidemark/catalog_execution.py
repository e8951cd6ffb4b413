"""Registered queries over executed orders and their book, lookups, training frames and risk by method, with their oracle SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from .catalog import _full, _MOMENTUM, _returns, LOGS, query, W
from .functions import causal as c
from .operators import backtest, evaluation, execution, labels, relational, risk
from .sources import derived

_ORDERS = """(SELECT o_orderkey AS id, o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOUR AS decision_ts,
  CAST(o_custkey % 6 - 2.5 AS DOUBLE) / 10 AS q, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS lim FROM orders)"""
_MET = f"(SELECT o.*, b.ts AS execution_ts, b.open, b.high, b.low, b.volume FROM {_ORDERS} o ASOF LEFT JOIN bars b ON o.symbol = b.symbol AND o.decision_ts < b.ts)"
_STATUS = f"""(SELECT *, CASE WHEN execution_ts IS NULL THEN 'no_later_bar' WHEN NOT open > 0 THEN 'non_positive_reference_price' WHEN abs(q) > 0.25 * volume THEN 'exceeds_max_participation'
    WHEN q > 0 AND low > lim OR q < 0 AND high < lim THEN 'limit_not_reached' ELSE 'filled' END AS status,
  CASE WHEN lim IS NULL THEN open WHEN q > 0 THEN least(open, lim) ELSE greatest(open, lim) END AS better FROM {_MET})"""
_FILLED = f"""(SELECT *, CASE WHEN status = 'filled' THEN better END AS reference, CASE WHEN status = 'filled' THEN better * (1 + sign(q) * (CAST(5 AS DOUBLE) / 10000 + CAST(0.02 AS DOUBLE) * sqrt(least(abs(q) / volume, 0.25)))) END AS fill_price
  FROM {_STATUS})"""


@query("executed_orders", f"""SELECT id, symbol, execution_ts, status, reference, fill_price / reference AS fill_ratio,
    CASE WHEN status = 'filled' THEN least(greatest(0.01 * abs(q), 1.0), 0.01 * abs(q * fill_price)) END AS commission, abs(fill_price - reference) / reference AS slipped FROM {_FILLED}""", "reference fill_ratio commission slipped", "execution_ts")  # fmt: skip
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("decision_ts"),
        ((F.col("o_custkey") % 6 - 2.5) / 10).alias("quantity"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("limit_price"),
    )
    got = execution.executed(orders, derived.bars(spark, sf_dir), costs=backtest.COSTS["pessimistic"])
    share = F.col("slippage") / (F.abs("quantity") * F.col("reference"))
    return got.select("id", "symbol", "execution_ts", "status", "reference", (F.col("fill_price") / F.col("reference")).alias("fill_ratio"), "commission", share.alias("slipped"))


START = 100_000_000.0
_FLOWS = f"""b AS (SELECT symbol, ts, close, lead(ts) OVER ({W}) AS fill_ts, lead(open) OVER ({W}) AS fill_open FROM bars),
  t AS (SELECT m.symbol, m.ts, fill_ts, fill_open, sign(weight) * floor(abs(weight * {START} / close)) AS q FROM {_MOMENTUM} m JOIN b ON b.symbol = m.symbol AND b.ts = m.ts WHERE close > 0 AND fill_open > 0),
  o AS (SELECT symbol, fill_ts AS ts, q - coalesce(lag(q) OVER ({W}), 0) AS d, fill_open FROM t),
  f AS (SELECT symbol, ts, d, fill_open * (1 + sign(d) * 5 / 10000) AS price FROM o WHERE d <> 0),
  p AS (SELECT symbol, ts, d, d * price + least(greatest(0.005 * abs(d), 1.0), 0.01 * abs(d * price)) AS paid FROM f),
  held AS (SELECT b.symbol, b.ts, close * sum(coalesce(d, 0)) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS held FROM b LEFT JOIN p ON p.symbol = b.symbol AND p.ts = b.ts),
  grid AS (SELECT s.symbol, d.ts FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT ts FROM bars) d),
  worth AS (SELECT g.ts, sum(coalesce(h.held, 0)) AS held FROM grid g ASOF LEFT JOIN held h ON g.symbol = h.symbol AND g.ts >= h.ts GROUP BY g.ts),
  cash AS (SELECT w.ts, {START} - sum(coalesce(x.paid, 0)) OVER (ORDER BY w.ts ROWS UNBOUNDED PRECEDING) AS cash FROM worth w LEFT JOIN (SELECT ts, sum(paid) AS paid FROM p GROUP BY ts) x ON x.ts = w.ts)"""


@query("book_equity", f"WITH {_FLOWS} SELECT w.ts, cash / {START} AS cash, held / {START} AS held, (cash + held) / {START} AS equity FROM worth w JOIN cash ON cash.ts = w.ts", "cash held equity", "ts")
def _(spark, sf_dir):
    """The whole book of the momentum targets, as a multiple of what it starts with."""
    b = derived.bars(spark, sf_dir)
    made = execution.book(backtest.momentum_targets(b), b, START, costs=backtest.COSTS["realistic"])
    return made["equity"].select("ts", *((F.col(x) / START).alias(x) for x in ("cash", "held", "equity")))


@query("book_fills", f"WITH {_FLOWS} SELECT symbol, ts, d AS quantity FROM p", "quantity", "ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    fills = execution.book(backtest.momentum_targets(b), b, START, costs=backtest.COSTS["realistic"])["fills"]
    return fills.select("symbol", F.col("execution_ts").alias("ts"), "quantity")


@query("latest_known_forecast", "SELECT b.symbol, b.ts, p.model, p.y_pred FROM bars b LEFT JOIN preds p ON p.symbol = b.symbol AND p.ts = b.ts AND p.available_at <= b.ts + INTERVAL 22 HOUR AND p.model <> 'last1'", "y_pred", "ts")
def _(spark, sf_dir):
    """The forecasts of two models under a key of symbol, instant and model, as known an hour after a bar is."""
    book = derived.predictions(spark, sf_dir)
    b = derived.bars(spark, sf_dir).select("symbol", "ts", (F.col("ts") + F.expr("INTERVAL 22 HOURS")).alias("as_of"), F.explode(F.array(F.lit("hist21"), F.lit("zero"))).alias("model"))
    got = relational.lookup(b, book, "y_pred", ["model", "symbol", "ts"])
    found = got.where("y_pred is not null").select("symbol", "ts", "model", "y_pred")
    return b.select("symbol", "ts").distinct().join(found, ["symbol", "ts"], "left")


@query("paired_forecasts", "SELECT a.symbol, a.ts, a.y_true, a.y_pred, b.y_pred AS y_pred_base FROM preds a JOIN preds b ON a.symbol = b.symbol AND a.ts = b.ts WHERE a.model = 'last1' AND b.model = 'hist21'", "y_true y_pred y_pred_base", "ts")
def _(spark, sf_dir):
    return evaluation.paired_forecasts(derived.predictions(spark, sf_dir), "last1", "hist21")


@query("training_frame", f"""SELECT symbol, ts, available_at, label_available_at, ret_5d, ret_21d, label FROM (SELECT symbol, ts, available_at, close / lag(close, 5) OVER ({W}) - 1 AS ret_5d, close / lag(close, 21) OVER ({W}) - 1 AS ret_21d,
    lead(close, 5) OVER ({W}) / close - 1 AS label, lead(available_at, 5) OVER ({W}) AS label_available_at FROM bars) WHERE ret_5d IS NOT NULL AND ret_21d IS NOT NULL AND label IS NOT NULL""", "ret_5d ret_21d label", "ts available_at label_available_at")  # fmt: skip
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    features = b.select("symbol", "ts", "available_at", c.pct_change(F.col("close"), 5).alias("ret_5d"), c.pct_change(F.col("close"), 21).alias("ret_21d"))
    return labels.training_frame(features, labels.forward_labels(b, 5), ["ret_5d", "ret_21d"])


@query("stored_log_returns", f"""SELECT * FROM (SELECT symbol, ts, 'trailing' AS direction, available_at, ln(close / lag(close, 5) OVER ({W})) AS value FROM bars
    UNION ALL SELECT symbol, ts, 'forward', lead(available_at, 5) OVER ({W}), ln(lead(close, 5) OVER ({W}) / close) FROM bars) WHERE value IS NOT NULL""", "value", "ts available_at")  # fmt: skip
def _(spark, sf_dir):
    return labels.stored_returns(derived.bars(spark, sf_dir), (5,), method="log").drop("horizon")


_Z = NormalDist().inv_cdf(0.05)
_MOMENTS = ", ".join(f"avg(lr ** {k}) OVER w AS m{k}" for k in (1, 2, 3, 4))
_SHAPES = f"""(SELECT symbol, ts, n, m1, sd, (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / v ** 1.5 AS s, (m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4) / v ** 2 - 3 AS k
  FROM (SELECT *, m2 - m1 * m1 AS v FROM (SELECT symbol, ts, count(lr) OVER w AS n, stddev_samp(lr) OVER w AS sd, {_MOMENTS} FROM {LOGS} WINDOW w AS ({W} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))))"""


@query("rolling_var_by_method", f"""SELECT symbol, ts, CASE WHEN n = 63 THEN m1 + {_Z} * sd END AS parametric,
    CASE WHEN n = 63 THEN m1 + ({_Z} + {_Z**2 - 1} * s / 6 + {_Z**3 - 3 * _Z} * k / 24 - {2 * _Z**3 - 5 * _Z} * s ** 2 / 36) * sd END AS cornish_fisher FROM {_SHAPES}""", "parametric cornish_fisher", "ts")  # fmt: skip
def _(spark, sf_dir):
    rows = derived.bars(spark, sf_dir).select("symbol", "ts", c.log_return(F.col("close")).alias("lr"))
    return rows.select("symbol", "ts", *(risk.rolling_var(F.col("lr"), 63, method=m).alias(m) for m in ("parametric", "cornish_fisher")))


@query("trailing_volatility", f"""SELECT symbol, ts, CASE WHEN count(lr) OVER a >= 20 THEN stddev_samp(lr) OVER a END * sqrt(252) AS inclusive, CASE WHEN count(lr) OVER b >= 20 THEN stddev_samp(lr) OVER b END AS exclusive
    FROM {LOGS} WINDOW a AS ({W} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)""", "inclusive exclusive", "ts")  # fmt: skip
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    seen, before = risk.trailing_volatility(b, 63, "close", periods=252), risk.trailing_volatility(b, 63, "close", inclusive=False)
    return seen.withColumnRenamed("sigma", "inclusive").join(before.withColumnRenamed("sigma", "exclusive"), ["symbol", "ts"])
