"""Registered queries over streams, aggregates of any statistic, rules with memory and rank correlations, with their oracle SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalog import _returns, query
from .operators import kendall, statistics, strategies
from .sources import derived
from .streaming import bars as stream_bars
from .streaming import keyed, resolution, tables

AS_OF = "1996-06-01 00:00:00"
#: Days until a forecast's label is known in the queries below: by the day of the month, the longer ones past the patience.
_WAIT = "day(target_ts) % 13"
_RESOLVED = f"""SELECT p.model, p.symbol, p.ts, p.target_ts, p.y_pred, l.y_true, l.resolved_at FROM preds p LEFT JOIN (
    SELECT model, symbol, target_ts, y_true, CAST(target_ts + to_days(CAST({_WAIT} AS INTEGER)) AS TIMESTAMP) AS resolved_at FROM preds) l
  ON l.model = p.model AND l.symbol = p.symbol AND l.target_ts = p.target_ts AND l.resolved_at <= p.target_ts + INTERVAL 10 DAY AND l.resolved_at <= TIMESTAMP '{AS_OF}'
  WHERE p.target_ts > p.ts AND (l.resolved_at IS NOT NULL OR p.target_ts + INTERVAL 10 DAY < TIMESTAMP '{AS_OF}')"""


@query("forecast_resolution", _RESOLVED, "y_pred y_true", "ts target_ts resolved_at")
def _(spark, sf_dir):
    made = derived.predictions(spark, sf_dir)
    label_at = (F.col("target_ts") + F.make_dt_interval(days=F.day("target_ts") % 13)).alias("label_at")
    labels = made.where("model = 'zero'").select("symbol", "target_ts", label_at, "y_true")  # the three models share their labels
    return resolution.resolve_forecasts(made, labels, as_of=AS_OF)


_GATED = """SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 1 HOUR AS stop,
    time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) + INTERVAL 75 MINUTE AS available_at, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS ticks
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2
  HAVING time_bucket(INTERVAL 1 HOUR, CAST(any_value(ts) AS TIMESTAMP)) + INTERVAL 135 MINUTE <= (SELECT max(ts) FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)"""

_TIMES = "start stop available_at"


def _ticks(events):
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("gated_hourly_bars", _GATED, "open high low close", _TIMES)
def _(spark, sf_dir):
    return stream_bars.gated_bars(_ticks(spark.read.parquet(f"{sf_dir}/events.parquet")))


@query("streamed_hourly_bars", _GATED, "open high low close", _TIMES)
def _(spark, sf_dir):
    return tables.run_to_table(spark, f"{sf_dir}/events.parquet", lambda events: stream_bars.gated_bars(_ticks(events)))


@query("last_arrival_per_user", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id", "value")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return keyed.last_arrivals(events, ["user_id"], "event_id")


_CURVE = "(SELECT symbol, ts, r, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY ts)) AS curve FROM rets WHERE r IS NOT NULL)"
_FALL = f"(SELECT symbol, r, curve, greatest(1.0, max(curve) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS top FROM {_CURVE})"


@query("return_statistics", f"SELECT symbol, median(r) AS median, min(curve / top) - 1 AS deepest FROM {_FALL} GROUP BY symbol", "median deepest")
def _(spark, sf_dir):
    r, ts = F.col("r"), F.col("ts")
    found = _returns(spark, sf_dir).groupBy("symbol")
    return found.agg(statistics.statistic(np.median)(r, ts).alias("median"), statistics.statistic(statistics.max_drawdown)(r, ts).alias("deepest"))


@query("rolling_median_21", """SELECT symbol, ts, CASE WHEN count(r) OVER w = 21 THEN median(r) OVER w END AS median_21 FROM rets
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""", "median_21", "ts")  # fmt: skip
def _(spark, sf_dir):
    return statistics.rolling_statistic(_returns(spark, sf_dir), np.median, "r", 21, "median_21").select("symbol", "ts", "median_21")


@query("bootstrap_median")
def _(spark, sf_dir):
    return statistics.bootstrap_statistic(_returns(spark, sf_dir), np.median, draws=200)


_STOP = """WITH RECURSIVE c AS (SELECT symbol, ts, available_at, close, row_number() OVER w AS i, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS before
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    s AS (SELECT symbol, i, CAST(NULL AS DOUBLE) AS top FROM c WHERE i = 1
      UNION ALL SELECT c.symbol, c.i, CASE WHEN s.top IS NOT NULL THEN CASE WHEN c.close >= greatest(s.top, c.close) * (1 - 0.1) THEN greatest(s.top, c.close) END
        WHEN c.i > 20 AND c.close > c.before THEN c.close END FROM s JOIN c ON c.symbol = s.symbol AND c.i = s.i + 1)
  SELECT symbol, ts, available_at AS decided_at, CASE WHEN top IS NULL THEN 0.0 ELSE 1.0 END AS weight FROM s JOIN c USING (symbol, i) WHERE i > 20"""


@query("trailing_stop_targets", _STOP, "weight", "ts decided_at")
def _(spark, sf_dir):
    return strategies.rule_targets(derived.bars(spark, sf_dir), strategies.TrailingStop)


_TAU = """WITH j AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.r AS x, b.r AS y FROM rets a JOIN rets b ON a.ts = b.ts WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
    p AS (SELECT u.a, u.b, sum(sign(u.x - v.x) * sign(u.y - v.y)) AS agree, sum(abs(sign(u.x - v.x))) AS nx, sum(abs(sign(u.y - v.y))) AS ny FROM j u JOIN j v ON u.a = v.a AND u.b = v.b GROUP BY 1, 2)
  SELECT a, b, n, CASE WHEN nx * ny > 0 THEN agree / sqrt(CAST(nx AS DOUBLE) * ny) END AS tau FROM p JOIN (SELECT a, b, count(*) AS n FROM j GROUP BY 1, 2) USING (a, b)"""


@query("kendall_correlations", _TAU, "tau")
def _(spark, sf_dir):
    returns = _returns(spark, sf_dir)
    symbols = sorted(r.symbol for r in returns.select("symbol").distinct().collect())
    wide = returns.groupBy("ts").pivot("symbol", symbols).agg(F.first("r"))
    return kendall.kendall(wide, symbols)
