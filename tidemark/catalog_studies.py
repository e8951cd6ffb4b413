"""Registered queries over stationarity, resampling, models, runs and studies, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _fold_sql, _folds, _full, _returns, CUT, NUMBERED, query, student_sql, SYMBOLS, W
from .functions import causal as c
from .operators import backtest, bootstrap, evaluation, inference, labels, learners, models, portfolio, quality, relational, runs, study
from .sources import derived

_LAGGED = ", ".join(f"sum(CASE WHEN a.i - b.i = {k} THEN a.d * b.d END) / any_value(a.n) AS g{k}" for k in range(3))
_GAMMAS = f"(SELECT a.symbol, any_value(a.n) AS n, {_LAGGED} FROM {NUMBERED} a JOIN {NUMBERED} b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 2 AND a.i GROUP BY a.symbol)"
_PARTIALS = f"""(SELECT symbol, n, g0, g1, g2, g1 * n / (n - 1.0) / g0 AS p1, g2 * n / (n - 2.0) / g0 AS r2 FROM {_GAMMAS})"""


@query("partial_autocorrelation", f"""SELECT symbol, n, CAST(k AS INTEGER) AS lag, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN g1 / g0 ELSE g2 / g0 END AS acf,
  CASE k WHEN 0 THEN 1.0 WHEN 1 THEN p1 ELSE (r2 - p1 ** 2) / (1 - p1 ** 2) END AS pacf, 1.96 / sqrt(n) AS band FROM {_PARTIALS}, range(3) t(k)""", "acf pacf band")  # fmt: skip
def _(spark, sf_dir):
    return inference.partial_autocorrelation(_returns(spark, sf_dir), lags=2)


@query("stationarity_verdicts")
def _(spark, sf_dir):
    return inference.stationarity(_returns(spark, sf_dir))


_LOSSES = "(SELECT symbol, (y_true - y_pred) ** 2 - y_true ** 2 AS d FROM preds WHERE model = 'hist21')"


@query("paired_t_test", f"SELECT *, {student_sql('t', '(n - 1)')} AS p FROM (SELECT symbol, count(*) AS n, avg(d) AS mean, avg(d) * sqrt(count(*)) / stddev_samp(d) AS t FROM {_LOSSES} GROUP BY symbol)", "mean t p")
def _(spark, sf_dir):
    y = F.col("y_true")
    rows = derived.predictions(spark, sf_dir).where("model = 'hist21'").select("symbol", ((y - F.col("y_pred")) ** 2).alias("a"), (y**2).alias("b"))
    return evaluation.paired_t(rows, "a", "b", "symbol")


DRAWS = 100
_VALUES = "(SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS place, r FROM rets WHERE r IS NOT NULL)"
_SUMS = f"""(SELECT symbol, place, sum(r) OVER w AS s1, sum(r * r) OVER w AS s2 FROM {_VALUES} WINDOW w AS (PARTITION BY symbol ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT DISTINCT symbol, 0, 0.0, 0.0 FROM {_VALUES})"""
_TOTALS = f"(SELECT symbol, count(*) AS n, sum(r) AS t1, sum(r * r) AS t2 FROM {_VALUES} GROUP BY symbol HAVING count(*) >= {bootstrap.LEAST})"


def _share_sql(kind: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('{kind}:0:' || draw || ':' || i), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296"


_CUTS = f"(SELECT *, CAST(floor({_share_sql('start')} * n) AS BIGINT) AS b FROM (SELECT *, unnest(range(n)) AS i FROM {_TOTALS}, range({DRAWS}) d(draw)) WHERE i = 0 OR {_share_sql('cut')} < 1.0 / 20)"
_BLOCKS = f"(SELECT *, b + coalesce(lead(i) OVER (PARTITION BY symbol, draw ORDER BY i), n) - i AS e FROM {_CUTS})"
_DRAWN = f"""(SELECT k.symbol, k.n, k.draw, sum(y.s1 - x.s1 + CASE WHEN k.e > k.n THEN k.t1 ELSE 0 END) AS s1, sum(y.s2 - x.s2 + CASE WHEN k.e > k.n THEN k.t2 ELSE 0 END) AS s2
  FROM {_BLOCKS} k JOIN {_SUMS} x ON x.symbol = k.symbol AND x.place = k.b JOIN {_SUMS} y ON y.symbol = k.symbol AND y.place = CASE WHEN k.e > k.n THEN k.e - k.n ELSE k.e END GROUP BY ALL)"""
_SHARPES = f"(SELECT symbol, s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) * sqrt(252) AS v FROM {_DRAWN})"
_INTERVALS = f"(SELECT symbol, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper, stddev_samp(v) AS spread, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS share_above_zero FROM {_SHARPES} GROUP BY symbol)"


@query("bootstrap_sharpe", f"SELECT t.symbol, t.n, t.t1 / t.n / sqrt((t.t2 - t.t1 * t.t1 / t.n) / (t.n - 1)) * sqrt(252) AS point, i.lower, i.upper, i.spread, i.share_above_zero FROM {_TOTALS} t JOIN {_INTERVALS} i ON i.symbol = t.symbol", "point lower upper spread share_above_zero")
def _(spark, sf_dir):
    return bootstrap.stationary_bootstrap(_returns(spark, sf_dir), draws=DRAWS)


_AHEAD = f"(SELECT CAST(year(ts) AS INTEGER) AS fold, r, lead(r) OVER ({W}) AS y FROM rets)"


@query("mean_importance", f"SELECT 'ridge' AS model, 'r' AS feature, avg(abs(b)) AS importance FROM (SELECT fold, covar_pop(r, y) / var_pop(r) * count(*) / (count(*) + 1.0) AS b FROM {_AHEAD} WHERE r IS NOT NULL AND y IS NOT NULL GROUP BY fold HAVING count(*) >= {models.LEAST_ROWS})", "importance")
def _(spark, sf_dir):
    rows = _returns(spark, sf_dir).select("symbol", "ts", "r").select(F.year("ts").alias("fold"), "r", F.lead("r").over(c.by_symbol()).alias("y"))
    fitted = models.fit(rows, ["r"], "y", "fold", models.ridge, alpha=1.0)
    return learners.mean_importance(fitted.select(F.lit("ridge").alias("model"), "fold", F.lit("r").alias("feature"), F.col("coefficients")[0].alias("importance")))


_UP = f"(SELECT symbol, ts, ts < TIMESTAMP '{CUT}' AS early, CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END AS label FROM preds WHERE model = 'hist21')"


@query("majority_class", f"SELECT 0 AS fold, symbol, ts, p AS y_pred, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, label AS y_true FROM {_UP}, (SELECT avg(label) AS p FROM {_UP} WHERE early) WHERE NOT early", "y_pred y_true", "ts")
def _(spark, sf_dir):
    rows = derived.predictions(spark, sf_dir).where("model = 'hist21'")
    role = F.when(F.col("ts") < CUT, "train").otherwise("test")
    return learners.majority_class(rows.select(F.lit(0).alias("fold"), role.alias("role"), "symbol", "ts", (F.col("y_true") > 0).cast("double").alias("label")))


@query("class_models_holdout")
def _(spark, sf_dir):
    """Logistic, forest and boosted trees on the last 126 dates; the trees with 50 members each."""
    b = derived.bars(spark, sf_dir)
    p = F.col("close")
    x = b.select("symbol", "ts", c.pct_change(p).alias("ret_1d"), c.pct_change(p, 5).alias("ret_5d"), c.pct_change(p, 21).alias("ret_21d"))
    dealt = labels.folds(labels.forward_labels(b, 5, classification=True).join(x, ["symbol", "ts"]).dropna(), kind="holdout")
    ladder = [learners.get("logistic"), learners.get("random_forest_clf", trees=50), learners.get("gradient_boosting_clf", iterations=50)]
    preds, _ = learners.walk_forward(dealt, ["ret_1d", "ret_5d", "ret_21d"], ladder)
    return preds


_ALL_FOLDS = f"({_fold_sql('0', 0)})"


@query("single_holdout", f"SELECT CAST(0 AS INTEGER) AS fold, role, n, first_ts, last_ts FROM {_ALL_FOLDS} WHERE fold = (SELECT max(fold) FROM {_ALL_FOLDS})", "", "first_ts last_ts")
def _(spark, sf_dir):
    return _folds(spark, sf_dir, kind="holdout")


_SHARE = "1.0 / count(*) OVER (PARTITION BY ts) AS share"


@query("crossover_with_shorts", f"SELECT symbol, ts, CASE WHEN f > s THEN share ELSE -share END AS weight FROM (SELECT symbol, ts, {_full(20, 'close', 'avg(close)')} AS f, {_full(100, 'close', 'avg(close)')} AS s, {_SHARE} FROM bars) WHERE s IS NOT NULL", "weight", "ts")
def _(spark, sf_dir):
    return backtest.ma_crossover_targets(derived.bars(spark, sf_dir), allow_short=True)


@query("momentum_with_shorts", f"SELECT symbol, ts, sign(past) * share AS weight FROM (SELECT symbol, ts, close / lag(close, 126) OVER ({W}) - 1 AS past, {_SHARE} FROM bars) WHERE past IS NOT NULL", "weight", "ts")
def _(spark, sf_dir):
    return backtest.momentum_targets(derived.bars(spark, sf_dir), allow_short=True)


@query("buy_and_hold_targets", "SELECT symbol, ts, 1.0 / (SELECT count(DISTINCT symbol) FROM bars) AS weight FROM bars", "weight", "ts")
def _(spark, sf_dir):
    return backtest.buy_and_hold_targets(derived.bars(spark, sf_dir))


@query("newest_rows", "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 5", "close", "ts")
def _(spark, sf_dir):
    return relational.newest_rows(derived.bars(spark, sf_dir).select("symbol", "ts", "close"), 5)


@query("page_with_total", "SELECT symbol, ts, (SELECT CAST(count(*) AS INTEGER) FROM bars) AS total FROM bars ORDER BY symbol, ts LIMIT 20 OFFSET 40", "", "ts")
def _(spark, sf_dir):
    return relational.page_with_total(derived.bars(spark, sf_dir).select("symbol", "ts"), ["symbol", "ts"], 20, 40).withColumn("total", F.col("total").cast("int"))


_BASED = f"(SELECT p.symbol, y_true, y_pred, base FROM preds p JOIN (SELECT symbol, avg(y_true) AS base FROM preds WHERE model = 'hist21' AND ts < TIMESTAMP '{CUT}' GROUP BY symbol) b ON b.symbol = p.symbol WHERE model = 'hist21' AND ts >= TIMESTAMP '{CUT}')"


@query("r2_against_training_mean", f"SELECT symbol, count(*) AS n, 1 - sum((y_true - y_pred) ** 2) / sum((y_true - base) ** 2) AS r2 FROM {_BASED} GROUP BY symbol", "r2")
def _(spark, sf_dir):
    preds = derived.predictions(spark, sf_dir).where("model = 'hist21'")
    base = preds.where(F.col("ts") < CUT).groupBy("symbol").agg(F.avg("y_true").alias("base"))
    return evaluation.r2_against(preds.where(F.col("ts") >= CUT).join(base, "symbol"), "base", "symbol")


_UNDER = f"(SELECT *, close < max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS under FROM rets)"
_ISLANDS = f"(SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM {_UNDER})"
_LONGEST = f"(SELECT symbol, max(k) AS longest FROM (SELECT symbol, count(*) AS k FROM {_ISLANDS} WHERE under GROUP BY symbol, island) GROUP BY symbol)"


@query("performance_shape", f"SELECT r.symbol, count(*) AS n, date_diff('second', min(ts), max(ts)) / (365.25 * 86400) AS years, skewness(r.r) AS skewness, kurtosis(r.r) AS excess_kurtosis, max(r.r) AS best, min(r.r) AS worst, coalesce(any_value(l.longest), 0) AS longest_underwater FROM rets r LEFT JOIN {_LONGEST} l ON l.symbol = r.symbol GROUP BY r.symbol", "years skewness excess_kurtosis best worst")
def _(spark, sf_dir):
    return backtest.performance_shape(derived.bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity")), "symbol")


_WANTED = "(SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'NONE')"


@query("stored_validation", f"SELECT w.symbol, count(b.ts) AS n, CAST(date_diff('day', max(b.ts), TIMESTAMP '1998-08-10') AS INTEGER) AS age_days, CASE WHEN count(b.ts) = 0 THEN 'FAIL' WHEN date_diff('day', max(b.ts), TIMESTAMP '1998-08-10') > 7 THEN 'WARN' ELSE 'PASS' END AS status FROM {_WANTED} w LEFT JOIN bars b ON b.symbol = w.symbol GROUP BY w.symbol")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    wanted = b.select("symbol").unionByName(spark.createDataFrame([("NONE",)], "symbol string"))
    return quality.validate_stored(b, wanted, F.lit("1998-08-10").cast("date"))


@query("universe_at", "SELECT DISTINCT symbol FROM membership WHERE valid_from <= TIMESTAMP '1996-05-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-05-01')")
def _(spark, sf_dir):
    found, _ = relational.resolve_universe(derived.bars(spark, sf_dir), members=derived.membership(spark, sf_dir), at="1996-05-01")
    return found


_DAILY = "(SELECT p.model, p.ts, avg((p.y_true - p.y_pred) ** 2 - (p.y_true - z.y_pred) ** 2) AS d FROM preds p JOIN preds z ON z.model = 'zero' AND z.symbol = p.symbol AND z.ts = p.ts WHERE p.model <> 'zero' GROUP BY 1, 2)"
_CENTRED = f"(SELECT model, row_number() OVER (PARTITION BY model ORDER BY ts) AS i, count(*) OVER (PARTITION BY model) AS n, avg(d) OVER (PARTITION BY model) AS mean, d - avg(d) OVER (PARTITION BY model) AS d, CAST(greatest(0, floor(4 * pow(count(*) OVER (PARTITION BY model) / 100.0, 2.0 / 9))) AS INTEGER) AS lags FROM {_DAILY})"
_VARIANCES = f"(SELECT a.model, a.n, a.lags, a.mean, sum(a.d * b.d * CASE WHEN a.i = b.i THEN 1.0 ELSE 2.0 * (1 - (a.i - b.i) / (a.lags + 1.0)) END) / a.n AS lrv FROM {_CENTRED} a JOIN {_CENTRED} b ON a.model = b.model AND b.i BETWEEN a.i - a.lags AND a.i GROUP BY a.model, a.n, a.lags, a.mean)"


_GAINS = f"(SELECT model, n, lags, mean, mean / sqrt(greatest(lrv, 1e-300) / n) * sqrt((n - 1.0) / n) AS statistic FROM {_VARIANCES} WHERE n >= 10)"
_GAINS_P = f"(SELECT *, {student_sql('statistic', '(n - 1)')} AS p FROM {_GAINS})"
_SIGNIFICANT = f"(SELECT * EXCLUDE raw, least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM {_GAINS_P}))"


@query("study_significance", f"SELECT * FROM {_SIGNIFICANT}", "mean statistic p p_adjusted")
def _(spark, sf_dir):
    return study.significance(derived.predictions(spark, sf_dir))


_BETS = "(SELECT model, symbol, ts, y_pred, y_true FROM preds UNION ALL SELECT DISTINCT 'buy_and_hold', symbol, ts, 1.0, y_true FROM preds)"
_HELD = f"(SELECT *, sign(y_pred) * 1.0 / count(*) OVER (PARTITION BY model, ts) AS w FROM {_BETS})"
_TRADED = f"(SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY model, symbol ORDER BY ts), 0)) AS traded FROM {_HELD})"
_COSTS = ", ".join(f"('{k}', {v})" for k, v in study.SCENARIOS.items())
_STRATEGIES = f"(SELECT model, scenario, ts, sum(w * y_true - traded * bps / 10000) AS r FROM {_TRADED}, (VALUES {_COSTS}) s(scenario, bps) GROUP BY 1, 2, 3)"


_ECONOMICS = f"(SELECT model, scenario, count(*) AS n, avg(r) AS mean, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(252) END AS sharpe FROM {_STRATEGIES} GROUP BY model, scenario)"


@query("study_economics", f"SELECT * FROM {_ECONOMICS}", "mean sharpe")
def _(spark, sf_dir):
    return study.economics(derived.predictions(spark, sf_dir))


_GATES = f"""(SELECT r.model, r.r2 > 0 AS better, coalesce(s.mean < 0 AND s.p_adjusted < 0.05, false) AS gains, coalesce(e.sharpe > h.sharpe, false) AS beats
  FROM (SELECT model, 1 - sum((y_true - y_pred) ** 2) / sum(y_true ** 2) AS r2 FROM preds WHERE model NOT IN ('zero', 'last1') GROUP BY model) r
  LEFT JOIN {_SIGNIFICANT} s ON s.model = r.model LEFT JOIN {_ECONOMICS} e ON e.model = r.model AND e.scenario = 'realistic'
  LEFT JOIN {_ECONOMICS} h ON h.model = 'buy_and_hold' AND h.scenario = 'realistic')"""
_PASSED = f"(SELECT count(*) AS models, count(*) FILTER (better) AS positive_r2, count(*) FILTER (gains) AS significant, count(*) FILTER (gains AND beats) AS economic FROM {_GATES})"


@query("study_verdict", f"""SELECT *, CASE WHEN models = 0 THEN 'unanswered' WHEN positive_r2 = 0 THEN 'no_improvement' WHEN significant = 0 THEN 'within_noise'
    WHEN economic = 0 THEN 'economically_irrelevant' ELSE 'provisional_yes' END AS verdict FROM {_PASSED}""")  # fmt: skip
def _(spark, sf_dir):
    return study.verdict(derived.predictions(spark, sf_dir), baselines=("zero", "last1"))


_CELLS = "concat_ws('|', coalesce('=' || n_name, '-'), coalesce('=' || n_nationkey, '-'), coalesce('=' || n_regionkey, '-'))"


@query("frame_fingerprint", f"SELECT count(*) AS n, CAST(sum(d) AS VARCHAR) AS total, bit_xor(d) AS mix FROM (SELECT CAST('0x' || substr(md5({_CELLS}), 1, 15) AS BIGINT) AS d FROM nation)")
def _(spark, sf_dir):
    return runs.fingerprint(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"))


@query("path_slugs", "SELECT DISTINCT symbol, regexp_replace(regexp_replace(symbol, '[^A-Za-z0-9._=-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM bars")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).select("symbol", runs.slug(F.col("symbol")).alias("slug")).distinct()


@query("stored_metrics", "SELECT symbol, avg(r) AS mean, CAST(count(r) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS absent FROM rets GROUP BY symbol", "mean n")
def _(spark, sf_dir):
    kept = _returns(spark, sf_dir).groupBy("symbol").agg(F.to_json(F.struct(F.avg("r").alias("mean"), F.count("r").alias("n"))).alias("metrics"))
    return kept.select("symbol", *(runs.metric("metrics", k).alias(k) for k in ("mean", "n", "absent")))


@query("efficient_frontier")
def _(spark, sf_dir):
    monthly = derived.bars(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    return portfolio.frontier(monthly.select("symbol", "ts", c.pct_change(F.col("close")).alias("r")).where("r is not null"), SYMBOLS)
