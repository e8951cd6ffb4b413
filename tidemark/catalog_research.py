"""More registered queries: instants, registries, regressions, books and comparisons, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _DIFF, _LAGS, _RANKS, ALIGNED, AS_OF, LONG, W, _aligned, _long, _long_run_sql, _returns, _tests, _TESTS, normal_sql, query  # noqa: F401
from .functions import causal as c
from .operators import backtest, evaluation, regression, registry, relational, risk
from .sources import derived, landing


def _close_sql(zone: str, minutes: int) -> str:
    return f"((CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL {minutes} MINUTE) AT TIME ZONE '{zone}') AT TIME ZONE 'UTC'"


_CLOSES = ", ".join(f"{_close_sql(zone, 60 * h + m)} AS {name}" for name, (zone, h, m) in landing.SESSIONS.items())


@query("session_close_instants", f"SELECT ts, {_CLOSES} FROM (SELECT DISTINCT ts FROM bars)", "", "ts " + " ".join(landing.SESSIONS))
def _(spark, sf_dir):
    days = derived.bars(spark, sf_dir).select("ts").distinct()
    return days.select("ts", *(landing.close_instant(F.col("ts"), name).alias(name) for name in landing.SESSIONS))


@query("series_publication_instants", "SELECT code, ts, ts + to_days(CASE code WHEN 'A' THEN 1 WHEN 'N' THEN 45 ELSE 120 END) + INTERVAL 810 MINUTE AS known FROM macro", "", "ts known")
def _(spark, sf_dir):
    series = F.when(F.col("code") == "A", "DGS10").when(F.col("code") == "N", "unknown").otherwise("GDPC1")
    return derived.macro(spark, sf_dir).select("code", "ts", landing.published_at(F.col("ts"), landing.lag_of(series)).alias("known"))


_PERIODS = "strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, year(ts) || '-Q' || quarter(ts) AS quarter, strftime(ts, '%Y') AS year"


@query("period_keys", f"SELECT ts, {_PERIODS} FROM (SELECT DISTINCT ts FROM bars)", "", "ts")
def _(spark, sf_dir):
    days = derived.bars(spark, sf_dir).select("ts").distinct()
    return days.select("ts", *(landing.period_key(F.col("ts"), k).alias(k) for k in ("day", "week", "month", "quarter", "year")))


_GAPS = f"(SELECT symbol, epoch(ts) - epoch(lag(ts) OVER ({W})) AS gap FROM bars)"
_MEDIANS = f"(SELECT symbol, count(*) AS n, quantile_cont(gap, 0.5) / 86400 AS days FROM {_GAPS} GROUP BY symbol)"


@query("periods_per_year", f"SELECT symbol, CAST(CASE WHEN n < 3 OR days <= 0 THEN 252 WHEN days <= 0.25 THEN greatest(1, round(365.25 / days)) WHEN days <= 3 THEN 252 WHEN days <= 10 THEN 52 WHEN days <= 45 THEN 12 WHEN days <= 130 THEN 4 ELSE 1 END AS INTEGER) AS periods FROM {_MEDIANS}")
def _(spark, sf_dir):
    return evaluation.infer_periods(derived.bars(spark, sf_dir))


@query("macro_as_of", f"SELECT * FROM macro WHERE available_at <= TIMESTAMP '{AS_OF}'", "value", "ts available_at")
def _(spark, sf_dir):
    return relational.as_of_filter(derived.macro(spark, sf_dir), AS_OF)


@query("features_load_as_of", f"SELECT symbol, ts, available_at, name, value FROM {LONG} WHERE symbol IN ('1-URGENT', '5-LOW') AND name = 'ret_21d' AND value IS NOT NULL AND available_at <= TIMESTAMP '{AS_OF}'", "value", "ts available_at")
def _(spark, sf_dir):
    long = _long(spark, sf_dir).where("value is not null").withColumn("feature_set_id", F.lit("demo-v1"))
    return registry.load_values(long, "demo-v1", ["1-URGENT", "5-LOW"], ["ret_21d"], AS_OF).drop("feature_set_id")


@query("feature_matrix", f"SELECT symbol, ts, max(CASE WHEN name = 'ret_5d' THEN value END) AS ret_5d, max(CASE WHEN name = 'ret_21d' THEN value END) AS ret_21d FROM {LONG} WHERE value IS NOT NULL GROUP BY symbol, ts", "ret_5d ret_21d", "ts")
def _(spark, sf_dir):
    return registry.load_matrix(_long(spark, sf_dir).where("value is not null"), ["ret_5d", "ret_21d"])


@query("returns_scan", "SELECT symbol, ts, value FROM (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS value FROM bars) WHERE value IS NOT NULL AND symbol <> '5-LOW'", "value", "ts")
def _(spark, sf_dir):
    from .operators import labels

    kept = labels.stored_returns(derived.bars(spark, sf_dir)).where("horizon = 5 and direction = 'forward' and symbol <> '5-LOW'")
    return kept.select("symbol", "ts", "value")


_MONTHS = ", ".join(f"max(CASE WHEN m = {k} THEN r END) AS m{k}" for k in range(1, 13))
_MONTHLY = "(SELECT symbol, month, last_close / lag(last_close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM (SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(close, ts) AS last_close FROM bars GROUP BY 1, 2))"


@query("monthly_returns_by_year", f"SELECT symbol, CAST(y AS INTEGER) AS y, {_MONTHS} FROM (SELECT symbol, year(month) AS y, month(month) AS m, r FROM {_MONTHLY}) GROUP BY symbol, y", " ".join(f"m{k}" for k in range(1, 13)))
def _(spark, sf_dir):
    monthly = derived.bars(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.max_by("close", "ts").alias("last"))
    r = F.try_divide("last", F.lag("last").over(c.W.partitionBy("symbol").orderBy("month"))) - 1
    rows = monthly.select("symbol", F.year("month").alias("y"), F.concat(F.lit("m"), F.month("month")).alias("m"), r.alias("r"))
    return rows.groupBy("symbol", "y").pivot("m", [f"m{k}" for k in range(1, 13)]).agg(F.max("r"))


@query("feature_label_one_to_one", "SELECT a.symbol, a.ts, a.r AS x, b.r AS y FROM rets a JOIN (SELECT symbol, ts, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM rets) b ON a.symbol = b.symbol AND a.ts = b.ts WHERE a.r IS NOT NULL AND b.r IS NOT NULL", "x y", "ts")
def _(spark, sf_dir):
    r = _returns(spark, sf_dir).select("symbol", "ts", "r")
    ahead = r.select("symbol", "ts", F.lead("r").over(c.by_symbol()).alias("y"))
    return relational.one_to_one(r.withColumnRenamed("r", "x"), ahead, ["symbol", "ts"]).dropna()


@query("fold_metrics", "SELECT model, CAST(year(ts) AS INTEGER) AS fold, count(*) AS n, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY 1, 2", "mse rmse mae")
def _(spark, sf_dir):
    folds = derived.predictions(spark, sf_dir).withColumn("fold", F.year("ts"))
    return evaluation.forecast_metrics(folds, "model", "fold").select("model", "fold", "n", "mse", "rmse", "mae")


@query("best_strategy", "SELECT symbol, sharpe FROM (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM rets GROUP BY symbol) ORDER BY sharpe DESC, symbol LIMIT 1", "sharpe")
def _(spark, sf_dir):
    curves = derived.bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity"))
    return backtest.equity_metrics(curves, "symbol").select("symbol", "sharpe").orderBy(F.desc("sharpe"), "symbol").limit(1)


_BH = f"(SELECT symbol, least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM {_TESTS} WHERE symbol <> '5-LOW'))"


@query("summary_with_adjusted_p", f"SELECT s.symbol, s.n, a.p_adjusted FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) s LEFT JOIN {_BH} a ON a.symbol = s.symbol", "p_adjusted")
def _(spark, sf_dir):
    summary = derived.bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    adjusted = evaluation.adjust_pvalues(_tests(spark, sf_dir).where("symbol <> '5-LOW'"))
    return summary.join(adjusted.select("symbol", "p_adjusted"), "symbol", "left")


_JOINT = "(SELECT a.symbol AS a, b.symbol AS b, a.r AS x, b.r AS y FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol <= b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"
_RANKED = f"(SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM {_JOINT})"


@query("spearman_correlations", f"SELECT a, b, count(*) AS n, corr(rx, ry) AS spearman FROM {_RANKED} GROUP BY a, b", "spearman")
def _(spark, sf_dir):
    return risk.rank_pairwise(_returns(spark, sf_dir))


_SQUARES = " UNION ALL ".join(f"SELECT symbol, count(*) AS n, {k} AS lag, sum(e * p) / sum(e * e) AS acf FROM (SELECT symbol, e, lag(e, {k}) OVER ({W}) AS p FROM (SELECT symbol, ts, r * r - avg(r * r) OVER (PARTITION BY symbol) AS e FROM rets WHERE r IS NOT NULL)) GROUP BY symbol" for k in range(1, 6))


@query("volatility_clustering", f"SELECT symbol, n, CAST(lag AS INTEGER) AS lag, acf, n * (n + 2) * sum(acf ** 2 / (n - lag)) OVER (PARTITION BY symbol ORDER BY lag ROWS UNBOUNDED PRECEDING) AS ljung_box FROM ({_SQUARES})", "acf ljung_box")
def _(spark, sf_dir):
    return risk.volatility_clustering(_returns(spark, sf_dir))


_SCREEN_ROWS = f"(SELECT symbol, ts, r, close / lag(close, 5) OVER ({W}) - 1 AS r5, lead(r) OVER ({W}) AS y FROM rets)"
_SCREEN = f"(SELECT feature, symbol, ts, x, y FROM (SELECT 'r' AS feature, symbol, ts, r AS x, y FROM {_SCREEN_ROWS} UNION ALL SELECT 'r5', symbol, ts, r5, y FROM {_SCREEN_ROWS}) WHERE x IS NOT NULL AND y IS NOT NULL)"
_FIT = f"(SELECT feature, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b, var_pop(x) AS vx, covar_pop(x, y) ** 2 / (var_pop(x) * var_pop(y)) AS r2, CAST(greatest(1, floor(4 * pow(count(*) / 100.0, 2.0 / 9))) AS INTEGER) AS lags FROM {_SCREEN} GROUP BY feature)"
_SCORES = f"(SELECT s.feature, f.n, f.b, f.vx, f.r2, f.lags, row_number() OVER (PARTITION BY s.feature ORDER BY ts, symbol) AS i, (x - mx) * (y - my - b * (x - mx)) AS d FROM {_SCREEN} s JOIN {_FIT} f ON f.feature = s.feature)"
_SCREENED = f"(SELECT a.feature, a.n, a.b, a.vx, a.r2, sum(a.d * e.d * CASE WHEN a.i = e.i THEN 1.0 ELSE 2.0 * (1 - (a.i - e.i) / (a.lags + 1.0)) END) AS s FROM {_SCORES} a JOIN {_SCORES} e ON e.feature = a.feature AND e.i BETWEEN a.i - a.lags AND a.i GROUP BY a.feature, a.n, a.b, a.vx, a.r2)"


def _regressors(spark, sf_dir):
    p = F.col("close")
    rows = derived.bars(spark, sf_dir).select("symbol", "ts", c.pct_change(p).alias("r"), c.pct_change(p, 5).alias("r5"), c.forward_return(p, 1).alias("y"))
    # one order of all rows: by instant, then by the number that a symbol begins with
    return rows.withColumn("at", F.unix_seconds("ts") * 10 + F.substring("symbol", 1, 1).cast("long"))


@query("univariate_screen", f"SELECT *, 2 * (1 - {normal_sql('abs(t)')}) AS p FROM (SELECT feature, n, b AS coefficient, b / (sqrt(s * n / (n - 2)) / (n * vx)) AS t, r2 FROM {_SCREENED})", "coefficient t r2 p")
def _(spark, sf_dir):
    return regression.univariate_screen(_regressors(spark, sf_dir), ["r", "r5"], "y", "at")


@query("variance_inflation", f"SELECT f AS feature, 1 / (1 - corr(r, r5) ** 2) AS vif FROM {_SCREEN_ROWS}, (VALUES ('r'), ('r5')) v(f) WHERE r IS NOT NULL AND r5 IS NOT NULL GROUP BY f", "vif")
def _(spark, sf_dir):
    return regression.variance_inflation(_regressors(spark, sf_dir), ["r", "r5"])


_SIDES = "(SELECT symbol, ts, y_pred, CASE WHEN y_pred > 0 THEN 1 WHEN y_pred < 0 THEN -1 ELSE 0 END AS side FROM preds WHERE model = 'hist21')"
_CHOSEN = f"(SELECT *, side <> 0 AND row_number() OVER (PARTITION BY ts, side ORDER BY side * y_pred DESC, symbol) <= 2 AS chosen FROM {_SIDES})"
_BOOK = f"(SELECT symbol, ts, CASE WHEN chosen THEN side * 1.0 / sum(CAST(chosen AS INTEGER)) OVER (PARTITION BY ts) ELSE 0.0 END AS weight FROM {_CHOSEN})"


def _book(spark, sf_dir):
    return backtest.long_short_targets(derived.predictions(spark, sf_dir).where("model = 'hist21'"), 0.0, 0.0, 2)


@query("long_short_targets", f"SELECT * FROM {_BOOK}", "weight", "ts")
def _(spark, sf_dir):
    return _book(spark, sf_dir)


_SIGMA = f"(SELECT symbol, ts, CASE WHEN count(r) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) = 21 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END * sqrt(252) AS sigma FROM rets)"


@query("volatility_scaled_targets", f"SELECT b.symbol, b.ts, greatest(-2.0, least(2.0, b.weight * 0.1 / CASE WHEN s.sigma > 1e-8 THEN s.sigma ELSE 0.2 END)) AS weight FROM {_BOOK} b LEFT JOIN {_SIGMA} s ON s.symbol = b.symbol AND s.ts = b.ts", "weight", "ts")
def _(spark, sf_dir):
    sigma = _returns(spark, sf_dir).select("symbol", "ts", c.realised_volatility(F.col("r"), 21).alias("sigma"))
    return backtest.volatility_scaled(_book(spark, sf_dir), sigma)


_CHANGED = f"(SELECT ts, sum(abs(weight - before)) AS change, sum(abs(weight)) AS gross, sum(weight) AS net FROM (SELECT *, coalesce(lag(weight) OVER ({W}), 0) AS before FROM {_BOOK}) GROUP BY ts)"


@query("turnover_exposure", f"SELECT count(*) AS n, avg(change) * 252 AS turnover, avg(gross) AS gross, avg(net) AS net FROM {_CHANGED}", "turnover gross net")
def _(spark, sf_dir):
    return backtest.turnover_exposure(_book(spark, sf_dir))


_LOTS = "(SELECT symbol, o_totalprice AS price, CAST(trunc((o_custkey - 50) / 10.0) * 10 AS BIGINT) AS q FROM (SELECT o_orderpriority AS symbol, o_totalprice, o_custkey FROM orders))"


@query("trade_costs_by_symbol", f"""SELECT symbol, count(*) FILTER (q <> 0) AS trades, sum(abs(q * price)) AS notional,
    sum(CASE WHEN q = 0 THEN 0 ELSE least(greatest(0.005 * abs(q), 1.0), 0.01 * abs(q) * price * (1 + sign(q) * 5.0 / 10000)) END) AS commission, sum(abs(q * price)) * 5 / 10000 AS slippage FROM {_LOTS} GROUP BY symbol""", "notional commission slippage")  # fmt: skip
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fills = orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("price"), backtest.in_lots(F.col("o_custkey") - 50, 10).alias("quantity"))
    return backtest.trade_costs(fills)


@query("normalised_curves", "SELECT symbol, ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM bars", "equity", "ts")
def _(spark, sf_dir):
    return backtest.normalised_curves(derived.bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity")), "symbol")


_ALPHA = "(avg(r) - 0.02 / 252 - covar_samp(r, b) / var_samp(b) * (avg(b) - 0.02 / 252)) * 252"


@query("benchmark_alpha", f"SELECT symbol, count(*) AS n, covar_samp(r, b) / var_samp(b) AS beta, {_ALPHA} AS alpha, (avg(r) - 0.02 / 252) / stddev_samp(r) * sqrt(252) AS sharpe FROM {ALIGNED} GROUP BY symbol HAVING count(*) >= 3", "beta alpha sharpe")
def _(spark, sf_dir):
    return backtest.benchmark_alpha(_aligned(spark, sf_dir), risk_free=0.02)


@query("risk_summary", "SELECT symbol, stddev_samp(r) * sqrt(252) AS volatility, sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(252) AS downside_volatility, min(r) AS worst, max(r) AS best FROM rets WHERE r IS NOT NULL GROUP BY symbol HAVING count(*) >= 20", "volatility downside_volatility worst best")
def _(spark, sf_dir):
    return risk.summarise(_returns(spark, sf_dir)).select("symbol", "volatility", "downside_volatility", "worst", "best")
