"""Registered queries over the driver's tables, with their oracle SQL.

Both sides of a query list their columns under the same names; instants become text and doubles are rounded, so that
results of two engines can be compared by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import causal as c
from .operators import backtest, evaluation, features, inference, labels, models, portfolio, quality, relational, risk
from .sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6
AS_OF = "1996-06-30 12:00:00"


def shown(df: DataFrame) -> DataFrame:
    """Instants as text and doubles rounded; a negative zero becomes zero."""
    made = {"double": lambda x: F.round(x, DIGITS) + F.lit(0.0), "timestamp": lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*(made[t](F.col(f"`{n}`")).alias(n) if t in made else F.col(f"`{n}`") for n, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "", times: str = ""):
    """Registers a query; doubles and times name the oracle's columns that shown() changes."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: shown(f(spark, sf_dir))
        if sql:
            changes = [f"round({x}, {DIGITS}) + 0.0 AS {x}" for x in doubles.split()] + [f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {x}" for x in times.split()]
            change = f" REPLACE ({', '.join(changes)})" if changes else ""
            ORACLE[name] = f"WITH {derived.SQL.strip()}\nSELECT *{change} FROM ({sql})"
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["latest_return_volatility"](spark, sf_dir)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.bars(spark, sf_dir).select("symbol", "ts", "available_at", "close", c.pct_change(F.col("close")).alias("r"))


W = "PARTITION BY symbol ORDER BY ts"


def _w(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str, expr: str) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {expr} OVER {_w(n)} END"


def normal_sql(z: str) -> str:
    """The normal distribution function in SQL: its power series, in logarithms."""
    terms = f"list_sum([exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) for k in range(200)])"
    return f"(CASE WHEN {z} = 0 THEN 0.5 WHEN abs({z}) > 8 THEN CAST({z} > 0 AS DOUBLE) ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {terms} END)"


def student_sql(t: str, df: str) -> str:
    """Both tails of the t distribution in SQL: its finite series for whole degrees of freedom, in logarithms."""
    cos2 = f"({df} / CAST({df} + {t} * {t} AS DOUBLE))"
    even = f"list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5) + k * ln({cos2})) for k in range(CAST({df} AS BIGINT) // 2)])"
    odd = f"coalesce(list_sum([exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln({cos2})) for k in range((CAST({df} AS BIGINT) - 1) // 2)]), 0)"
    return f"(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN sqrt(1 - {cos2}) * {even} ELSE 2 / pi() * (asin(sqrt(1 - {cos2})) + sqrt((1 - {cos2}) * {cos2}) * {odd}) END)"


BAR = "open high low close adj_close volume"
LOGS = "(SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS lr FROM rets)"


@query("latest_return_volatility", f"SELECT symbol, ts, ret_21d, vol_21d FROM (SELECT symbol, ts, available_at, close / lag(close, 21) OVER ({W}) - 1 AS ret_21d, ({_full(21, 'lr', 'stddev_samp(lr)')}) * sqrt(252) AS vol_21d FROM {LOGS} WHERE available_at <= TIMESTAMP '{AS_OF}') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", "ret_21d vol_21d", "ts")
def _(spark, sf_dir):
    p = F.col("adj_close")
    seen = relational.as_of_filter(derived.bars(spark, sf_dir), AS_OF)
    rows = seen.withColumn("lr", c.log_return(p))
    rows = rows.select("symbol", "ts", c.pct_change(p, 21).alias("ret_21d"), c.realised_volatility(F.col("lr"), 21).alias("vol_21d"))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("ts", "ret_21d", "vol_21d"), "ts").alias("x"))
    return last.select("symbol", "x.*")


@query("bars_scan", "SELECT * FROM bars", BAR, "ts available_at")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir)


@query("bars_as_of", f"SELECT * FROM bars WHERE available_at <= TIMESTAMP '{AS_OF}'", BAR, "ts available_at")
def _(spark, sf_dir):
    return relational.as_of_filter(derived.bars(spark, sf_dir), AS_OF)


@query("bars_range_symbols", "SELECT * FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH') AND ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'", BAR, "ts available_at")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    return b.where(F.col("symbol").isin("1-URGENT", "2-HIGH") & F.col("ts").between("1994-01-01", "1995-06-30"))


@query("macro_scan", "SELECT * FROM macro", "value", "ts available_at")
def _(spark, sf_dir):
    return derived.macro(spark, sf_dir)


@query("asset_search_ilike", "SELECT DISTINCT symbol FROM bars WHERE symbol ILIKE '%h%'")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).where(F.col("symbol").ilike("%h%")).select("symbol").distinct()


@query("coverage_summary", "SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars GROUP BY symbol", "", "first_ts last_ts")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("latest_ts_watermark", "SELECT symbol, max(ts) - INTERVAL 5 DAY AS resume_from FROM bars GROUP BY symbol", "", "resume_from")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).groupBy("symbol").agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("resume_from"))


@query("page_offset_limit", "SELECT symbol, ts, close FROM bars ORDER BY symbol, ts LIMIT 50 OFFSET 100", "close", "ts")
def _(spark, sf_dir):
    return relational.page(derived.bars(spark, sf_dir).select("symbol", "ts", "close"), ["symbol", "ts"], 50, 100)


@query("row_counts_union", "SELECT 'bars' AS name, count(*) AS n FROM bars UNION ALL SELECT 'macro', count(*) FROM macro UNION ALL SELECT 'membership', count(*) FROM membership")
def _(spark, sf_dir):
    parts = [f(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(f.__name__).alias("name"), "n") for f in (derived.bars, derived.macro, derived.membership)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("wide_close_pivot", "SELECT ts, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN adj_close END) AS s{k}" for k, s in enumerate(SYMBOLS)) + " FROM bars GROUP BY ts", " ".join(f"s{k}" for k in range(5)), "ts")
def _(spark, sf_dir):
    wide = relational.wide_close(derived.bars(spark, sf_dir), SYMBOLS)
    return wide.select("ts", *(F.col(f"`{s}`").alias(f"s{k}") for k, s in enumerate(SYMBOLS)))


LONG = "(SELECT symbol, ts, available_at, 'ret_5d' AS name, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS value FROM bars UNION ALL SELECT symbol, ts, available_at, 'ret_21d', close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY ts) - 1 FROM bars)"


def _long(spark, sf_dir):
    p = F.col("close")
    wide = derived.bars(spark, sf_dir).select("symbol", "ts", "available_at", c.pct_change(p, 5).alias("ret_5d"), c.pct_change(p, 21).alias("ret_21d"))
    return relational.unpivot_features(wide, ["ret_5d", "ret_21d"])


@query("features_unpivot", f"SELECT * FROM {LONG}", "value", "ts available_at")
def _(spark, sf_dir):
    return _long(spark, sf_dir)


@query("features_pivot_last", f"SELECT symbol, ts, max(CASE WHEN name = 'ret_5d' THEN value END) AS ret_5d, max(CASE WHEN name = 'ret_21d' THEN value END) AS ret_21d FROM {LONG} GROUP BY symbol, ts", "ret_5d ret_21d", "ts")
def _(spark, sf_dir):
    return relational.pivot_features(_long(spark, sf_dir), ["ret_5d", "ret_21d"])


@query("monthly_returns_grid", "SELECT symbol, month, last_close / lag(last_close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM (SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(close, ts) AS last_close FROM bars GROUP BY 1, 2)", "r", "month")
def _(spark, sf_dir):
    monthly = derived.bars(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.max_by("close", "ts").alias("last"))
    w = c.W.partitionBy("symbol").orderBy("month")
    return monthly.select("symbol", "month", (F.try_divide("last", F.lag("last").over(w)) - 1).alias("r"))


@query("macro_asof_join", "SELECT b.symbol, b.ts, m.value AS macro_r FROM bars b ASOF LEFT JOIN (SELECT * FROM macro WHERE code = 'R') m ON b.available_at >= m.available_at", "macro_r", "ts")
def _(spark, sf_dir):
    m = derived.macro(spark, sf_dir).where("code = 'R'")
    return relational.asof_join(derived.bars(spark, sf_dir), m, "value", "macro_r").select("symbol", "ts", "macro_r")


@query("last_known_close_grid", "SELECT g.symbol, g.ts, b.close AS mark FROM (SELECT s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts FROM bars) t) g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts >= b.ts", "mark", "ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    months = b.select(F.date_trunc("month", "ts").alias("ts")).distinct()
    grid = months.select("ts", F.explode(F.array(*map(F.lit, SYMBOLS))).alias("symbol"))
    return relational.asof_join(grid, b, "close", "mark", ["symbol"], "ts").select("symbol", "ts", "mark")


@query("prediction_lookup_as_of", "SELECT b.symbol, b.ts, p.y_pred FROM bars b LEFT JOIN preds p ON p.model = 'hist21' AND p.symbol = b.symbol AND p.ts = b.ts AND p.available_at <= b.ts + INTERVAL 1 DAY", "y_pred", "ts")
def _(spark, sf_dir):
    book = derived.predictions(spark, sf_dir).where("model = 'hist21'")
    asked = derived.bars(spark, sf_dir).select("symbol", "ts", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("as_of"))
    return relational.lookup(asked, book, "y_pred", ["symbol", "ts"]).drop("as_of")


@query("universe_interval_join", "SELECT b.symbol, b.ts, m.valid_from FROM bars b JOIN membership m ON b.symbol = m.symbol AND m.valid_from <= b.ts AND (m.valid_to IS NULL OR m.valid_to > b.ts)", "", "ts valid_from")
def _(spark, sf_dir):
    joined = relational.interval_join(derived.bars(spark, sf_dir).select("symbol", "ts"), derived.membership(spark, sf_dir), keys=["symbol"])
    return joined.select("symbol", "ts", "valid_from")


@query("feature_label_join", "SELECT symbol, ts, x, y FROM (SELECT symbol, ts, close / lag(close, 21) OVER w - 1 AS x, lead(close, 5) OVER w / close - 1 AS y FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE x IS NOT NULL AND y IS NOT NULL", "x y", "ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    x = b.select("symbol", "ts", c.pct_change(F.col("close"), 21).alias("x")).where("x is not null")
    return x.join(labels.forward_labels(b, 5).select("symbol", "ts", F.col("label").alias("y")), ["symbol", "ts"])


@query("model_baseline_join", "SELECT a.symbol, a.ts, a.y_pred, b.y_pred AS y_pred_base, abs(a.y_true - b.y_true) AS gap FROM preds a JOIN preds b ON a.symbol = b.symbol AND a.ts = b.ts WHERE a.model = 'last1' AND b.model = 'hist21'", "y_pred y_pred_base gap", "ts")
def _(spark, sf_dir):
    p = derived.predictions(spark, sf_dir)
    base = p.where("model = 'hist21'").select("symbol", "ts", F.col("y_pred").alias("y_pred_base"), F.col("y_true").alias("yb"))
    both = p.where("model = 'last1'").join(base, ["symbol", "ts"])
    return both.select("symbol", "ts", "y_pred", "y_pred_base", F.abs(F.col("y_true") - F.col("yb")).alias("gap"))


@query("flat_symbols_anti_join", "SELECT symbol, ts FROM bars b WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.symbol = b.symbol AND p.ts = b.ts AND p.model = 'hist21' AND p.y_pred > 0)", "", "ts")
def _(spark, sf_dir):
    signal = derived.predictions(spark, sf_dir).where("model = 'hist21' and y_pred > 0")
    return derived.bars(spark, sf_dir).select("symbol", "ts").join(signal, ["symbol", "ts"], "left_anti")


@query("known_symbols_semi_join", "SELECT symbol, ts, close FROM bars WHERE symbol IN (SELECT symbol FROM membership WHERE valid_to IS NULL)", "close", "ts")
def _(spark, sf_dir):
    now = derived.membership(spark, sf_dir).where("valid_to is null")
    return derived.bars(spark, sf_dir).select("symbol", "ts", "close").join(now, "symbol", "left_semi")


@query("star_dimension_join", "SELECT r.r_name, n.n_name, count(*) AS n, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2", "total")
def _(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    joined = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


ALIGNED = "(SELECT a.symbol, a.ts, a.r, b.r AS b FROM rets a JOIN rets b ON a.ts = b.ts AND b.symbol = '1-URGENT' WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"


def _aligned(spark, sf_dir):
    r = _returns(spark, sf_dir).select("symbol", "ts", "r").where("r is not null")
    return r.join(r.where("symbol = '1-URGENT'").select("ts", F.col("r").alias("b")), "ts").select("symbol", "ts", "r", "b")


@query("benchmark_align", f"SELECT * FROM {ALIGNED}", "r b", "ts")
def _(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query("benchmark_beta_te_ir", f"SELECT symbol, count(*) AS n, covar_samp(r, b) / nullif(var_samp(b), 0) AS beta, stddev_samp(r - b) * sqrt(252) AS tracking_error, avg(r - b) / nullif(stddev_samp(r - b), 0) * sqrt(252) AS information_ratio FROM {ALIGNED} GROUP BY symbol HAVING count(*) >= 3", "beta tracking_error information_ratio")
def _(spark, sf_dir):
    return backtest.benchmark_stats(_aligned(spark, sf_dir))


@query("dedup_keep_last", "SELECT symbol, ts, close * 1.01 AS close FROM bars", "close", "ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir).select("symbol", "ts", "close")
    twice = b.withColumn("seq", F.lit(1)).unionByName(b.withColumn("close", F.col("close") * 1.01).withColumn("seq", F.lit(2)))
    return relational.dedup_keep_last(twice, ["symbol", "ts"], "seq").drop("seq")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return relational.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("upsert_prices", "SELECT symbol, ts, CASE WHEN symbol = '5-LOW' THEN close * 2 ELSE close END AS close FROM bars", "close", "ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir).select("symbol", "ts", "close")
    new = b.where("symbol = '5-LOW'").withColumn("close", F.col("close") * 2)
    return relational.upsert(b, new, ["symbol", "ts"])


@query("timeline_union_distinct", "SELECT ts, dense_rank() OVER (ORDER BY ts) AS place FROM (SELECT DISTINCT ts FROM bars)", "", "ts")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).select("ts").distinct().withColumn("place", F.dense_rank().over(c.W.orderBy("ts")).cast("long"))


@query("symbols_except", "SELECT DISTINCT symbol FROM bars EXCEPT SELECT symbol FROM membership WHERE valid_to IS NULL")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).select("symbol").distinct().exceptAll(derived.membership(spark, sf_dir).where("valid_to is null").select("symbol").distinct())


@query("symbols_intersect", "SELECT symbol FROM bars INTERSECT SELECT symbol FROM membership WHERE valid_to IS NULL")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).select("symbol").intersect(derived.membership(spark, sf_dir).where("valid_to is null").select("symbol"))


def _windows(spark, sf_dir, **columns):
    r = derived.bars(spark, sf_dir).withColumn("r", c.pct_change(F.col("close"))).withColumn("lr", c.log_return(F.col("close")))
    return r.select("symbol", "ts", *(v.alias(k) for k, v in columns.items()))


def _window_query(name: str, columns: dict[str, tuple]) -> None:
    """columns: name -> (function that makes the column, SQL)."""
    sql = ", ".join(f"{s} AS {k}" for k, (_, s) in columns.items())
    query(name, f"SELECT symbol, ts, {sql} FROM {LOGS}", " ".join(columns), "ts")(lambda spark, sf_dir: _windows(spark, sf_dir, **{k: v() for k, (v, _) in columns.items()}))


_x, _r, _lr = (lambda: F.col("close")), (lambda: F.col("r")), (lambda: F.col("lr"))
_std = lambda x, n: _full(n, x, f"stddev_samp({x})")
_window_query("lag_n", {"lag3": (lambda: c.lag(_x(), 3), f"lag(close, 3) OVER ({W})")})
_window_query("pct_change_n", {"p5": (lambda: c.pct_change(_x(), 5), f"close / lag(close, 5) OVER ({W}) - 1")})
_window_query("log_return_n", {"l5": (lambda: c.log_return(_x(), 5), f"ln(close) - lag(ln(close), 5) OVER ({W})")})
_window_query("rolling_mean_std", {"m": (lambda: c.rolling_mean(_r(), 21), _full(21, "r", "avg(r)")), "s": (lambda: c.rolling_std(_r(), 21), _std("r", 21))})
_window_query("rolling_sum_min_max", {"su": (lambda: c.rolling_sum(_x(), 10), _full(10, "close", "sum(close)")), "mi": (lambda: c.rolling_min(_x(), 10), _full(10, "close", "min(close)")), "ma": (lambda: c.rolling_max(_x(), 10), _full(10, "close", "max(close)"))})
_window_query("rolling_skew_kurt", {"sk": (lambda: c.rolling_skew(_lr(), 63), _full(63, "lr", "skewness(lr)")), "ku": (lambda: c.rolling_kurtosis(_lr(), 63), _full(63, "lr", "kurtosis(lr)"))})
_window_query("rolling_zscore", {"z": (lambda: c.rolling_zscore(_lr(), 21), f"(lr - ({_full(21, 'lr', 'avg(lr)')})) / nullif({_std('lr', 21)}, 0)")})
_window_query("realised_vol", {"v": (lambda: c.realised_volatility(_lr(), 21), f"({_std('lr', 21)}) * sqrt(252)")})
_window_query("trailing_vol_exclusive", {"v": (lambda: F.when(F.count("lr").over(c.by_symbol().rowsBetween(-21, -1)) >= 5, F.stddev_samp("lr").over(c.by_symbol().rowsBetween(-21, -1))), f"CASE WHEN count(lr) OVER ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) >= 5 THEN stddev_samp(lr) OVER ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) END")})
_window_query("drawdown", {"dd": (lambda: c.drawdown(_x()), f"close / max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1"), "dd252": (lambda: c.drawdown(_x(), 252), f"close / ({_full(252, 'close', 'max(close)')}) - 1")})
_window_query("rolling_var_hist", {"var": (lambda: risk.rolling_var(_r(), 63), _full(63, "r", "quantile_cont(r, 0.05)"))})
_window_query("price_to_ma", {f"ma{n}": (lambda n=n: F.try_divide(_x(), c.rolling_mean(_x(), n)) - 1, f"close / ({_full(n, 'close', 'avg(close)')}) - 1") for n in (20, 50, 200)})


@query("downside_vol", f"SELECT symbol, ts, ({_full(21, 'd', 'stddev_samp(d)')}) * sqrt(252) AS v FROM (SELECT *, CASE WHEN lr < 0 THEN lr ELSE 0.0 END AS d FROM {LOGS})", "v", "ts")
def _(spark, sf_dir):
    return _windows(spark, sf_dir, v=c.downside_volatility(F.col("lr"), 21))


@query("var_breach_rate", f"SELECT symbol, count(*) AS n, avg(CASE WHEN r < before THEN 1.0 ELSE 0.0 END) AS breach_rate FROM (SELECT symbol, r, lag(v) OVER ({W}) AS before FROM (SELECT symbol, ts, r, {_full(63, 'r', 'quantile_cont(r, 0.05)')} AS v FROM rets)) WHERE before IS NOT NULL AND r IS NOT NULL GROUP BY symbol", "breach_rate")
def _(spark, sf_dir):
    return risk.var_breach_rate(derived.bars(spark, sf_dir))


_PEAKS = f"(SELECT *, max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM bars)"
_UNDER = f"(SELECT symbol, ts, close / peak - 1 AS dd, close < peak AS under, CASE WHEN close < peak THEN 0 ELSE 1 END AS at_peak FROM {_PEAKS})"
_ISLANDS = f"(SELECT *, sum(at_peak) OVER ({W} ROWS UNBOUNDED PRECEDING) - at_peak AS island FROM {_UNDER})"
EPISODES = f"""(SELECT symbol, min(ts) FILTER (under) AS start, arg_min(ts, dd) AS trough_ts, max(ts) AS finish, min(dd) AS depth,
  count(*) AS length, count(*) FILTER (under) AS underwater
  FROM {_ISLANDS} GROUP BY symbol, island HAVING count(*) FILTER (under) > 0)"""


@query("drawdown_episodes_topk", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start) AS place FROM {EPISODES}) WHERE place <= 3", "depth", "start trough_ts finish")
def _(spark, sf_dir):
    curve = derived.bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity"))
    return backtest.drawdown_episodes(curve, "symbol", 3).withColumnRenamed("end", "finish").withColumn("place", F.col("place").cast("long"))


@query("underwater_duration", f"SELECT symbol, max(underwater) AS longest FROM {EPISODES} GROUP BY symbol")
def _(spark, sf_dir):
    curve = derived.bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity"))
    return backtest.drawdown_episodes(curve, "symbol", 1 << 30).groupBy("symbol").agg(F.max("underwater").alias("longest"))


def _recursive_sql(values: str, means: dict[str, str], alpha: str) -> str:
    """symbol, i, ts and the recursive mean of each expression over the numbered rows that `values` selects (symbol, i, ts, ...)."""
    first = ", ".join(f"{x} AS {k}" for k, x in means.items())
    step = ", ".join(f"e.{k} * (1 - {alpha}) + {alpha} * s.{x}" for k, x in means.items())
    return f"""(WITH RECURSIVE s AS MATERIALIZED ({values}), e AS (SELECT symbol, i, ts, {first} FROM s WHERE i = 1
      UNION ALL SELECT s.symbol, s.i, s.ts, {step} FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1) SELECT * FROM e)"""


_CLOSES = f"SELECT symbol, ts, close, row_number() OVER ({W}) AS i FROM bars"
_EWM = _recursive_sql(_CLOSES, {"ewm": "close"}, "(2.0 / 22)")


@query("ewm_mean", f"SELECT symbol, ts, CASE WHEN i >= 21 THEN ewm END AS ewm FROM {_EWM}", "ewm", "ts")
def _(spark, sf_dir):
    return c.ewm_mean(derived.bars(spark, sf_dir), "close", 21).select("symbol", "ts", "ewm")


_CHANGES = f"SELECT symbol, ts, greatest(c, 0) AS up, greatest(-c, 0) AS down, row_number() OVER ({W}) AS i FROM (SELECT symbol, ts, close - lag(close) OVER ({W}) AS c FROM bars) WHERE c IS NOT NULL"
_WILDER = _recursive_sql(_CHANGES, {"gain": "up", "loss": "down"}, "(1.0 / 14)")
_RSI_VALUE = "CASE WHEN i < 14 OR (gain = 0 AND loss = 0) THEN NULL WHEN loss = 0 THEN 100 WHEN gain = 0 THEN 0 ELSE 100 - 100 / (1 + gain / loss) END"
_RSI = f"(SELECT b.symbol, b.ts, {_RSI_VALUE} AS rsi FROM bars b LEFT JOIN {_WILDER} e ON e.symbol = b.symbol AND e.ts = b.ts)"
_RANGES = f"SELECT symbol, ts, greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS tr, row_number() OVER ({W}) AS i FROM (SELECT *, lag(close) OVER ({W}) AS p FROM bars)"
_ATR = f"(SELECT symbol, ts, CASE WHEN i >= 14 THEN atr END AS atr FROM {_recursive_sql(_RANGES, {'atr': 'tr'}, '(1.0 / 14)')})"


_SPARSE = """WITH RECURSIVE o AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars) WHERE i % 21 = 0),
    s AS (SELECT symbol, k, close AS m FROM o WHERE k = 1 UNION ALL
      SELECT o.symbol, o.k, (pow(1 - 2.0 / 253, 21) * s.m + 2.0 / 253 * o.close) / (pow(1 - 2.0 / 253, 21) + 2.0 / 253) FROM s JOIN o ON o.symbol = s.symbol AND o.k = s.k + 1)
  SELECT symbol, ts, m AS ewm FROM s JOIN o USING (symbol, k)"""


@query("ewm_sparse_series", _SPARSE, "ewm", "ts")
def _(spark, sf_dir):
    place = F.row_number().over(c.by_symbol()) - 1
    rows = derived.bars(spark, sf_dir).select("symbol", "ts", F.when(place % 21 == 0, F.col("close")).alias("x"))
    return c.ewm(rows, {"ewm": ("x", 2 / 253, 1)}).where("x IS NOT NULL").select("symbol", "ts", "ewm")


@query("rsi_14", f"SELECT * FROM {_RSI}", "rsi", "ts")
def _(spark, sf_dir):
    return c.rsi(derived.bars(spark, sf_dir), "adj_close").select("symbol", "ts", "rsi")


@query("atr_14", f"SELECT * FROM {_ATR}", "atr", "ts")
def _(spark, sf_dir):
    return c.average_true_range(derived.bars(spark, sf_dir)).select("symbol", "ts", "atr")


def _z(n: int, x: str) -> str:
    return f"({x} - ({_full(n, x, f'avg({x})')})) / nullif({_std(x, n)}, 0)"


_FEATURES = {f"ret_{n}d": f"close / lag(close, {n}) OVER ({W}) - 1" for n in (1, 5, 21)}
_FEATURES |= {f"mom_{n}d": f"close / lag(close, {n}) OVER ({W}) - 1" for n in (21, 63, 126, 252)}
_FEATURES["mom_252d_skip21"] = f"lag(close, 21) OVER ({W}) / lag(close, 252) OVER ({W}) - 1"
_FEATURES |= {f"vol_{n}d": f"({_std('lr', n)}) * sqrt(252)" for n in (21, 63)}
_FEATURES |= {f"downside_vol_{n}d": f"({_std('down', n)}) * sqrt(252)" for n in (21, 63)}
_FEATURES |= {f"price_to_ma_{n}": f"close / ({_full(n, 'close', 'avg(close)')}) - 1" for n in (20, 50, 200)}
_FEATURES["ma_ratio_20_100"] = f"({_full(20, 'close', 'avg(close)')}) / ({_full(100, 'close', 'avg(close)')}) - 1"
_FEATURES |= {f"ret_zscore_{n}d": _z(n, "r") for n in (21, 63)}
_FEATURES["volume_zscore_21d"] = _z(21, "lv")
_FEATURES["dollar_volume_ratio_21d"] = f"dv / ({_full(21, 'dv', 'avg(dv)')}) - 1"
_FEATURES["ret_skew_63d"] = _full(63, "r", "skewness(r)")
_FEATURES["drawdown_252d"] = f"close / ({_full(252, 'close', 'max(close)')}) - 1"
_INPUTS = f"(SELECT *, CASE WHEN lr < 0 THEN lr ELSE 0.0 END AS down, ln(1 + volume) AS lv, volume * close AS dv FROM {LOGS})"
_WINDOWS = f"(SELECT symbol, ts, available_at, close, {', '.join(f'{x} AS {k}' for k, x in _FEATURES.items())} FROM {_INPUTS})"
_ALL = f"""SELECT f.* EXCLUDE (close), rsi AS rsi_14, atr / f.close AS atr_14_normalised FROM {_WINDOWS} f
  JOIN {_RSI} r ON r.symbol = f.symbol AND r.ts = f.ts JOIN {_ATR} a ON a.symbol = f.symbol AND a.ts = f.ts WHERE ret_1d IS NOT NULL"""


@query("price_features_24", _ALL, " ".join([*_FEATURES, "rsi_14", "atr_14_normalised"]), "ts available_at")
def _(spark, sf_dir):
    return features.price_features(derived.bars(spark, sf_dir))


MACRO_LEVEL = "(SELECT b.symbol, b.ts, b.available_at, m.value AS level FROM bars b ASOF LEFT JOIN (SELECT * FROM macro WHERE code = 'A') m ON b.available_at >= m.available_at)"


@query("macro_features_level_chg_z", f"SELECT symbol, ts, available_at, level AS macro_a_level, level - lag(level, 21) OVER ({W}) AS macro_a_chg_21d, (level - ({_full(252, 'level', 'avg(level)')})) / nullif({_std('level', 252)}, 0) AS macro_a_z_252d FROM {MACRO_LEVEL}", "macro_a_level macro_a_chg_21d macro_a_z_252d", "ts available_at")
def _(spark, sf_dir):
    made = features.macro_features(derived.bars(spark, sf_dir), derived.macro(spark, sf_dir), ["A"])
    return made.toDF(*(n.lower() for n in made.columns))


@query("feature_coverage", "SELECT name AS feature, count(*) AS n_rows, count(value) AS n_values, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM " + LONG + " GROUP BY name", "coverage")
def _(spark, sf_dir):
    p = F.col("close")
    wide = derived.bars(spark, sf_dir).select(c.pct_change(p, 5).alias("ret_5d"), c.pct_change(p, 21).alias("ret_21d"))
    return relational.coverage(wide, ["ret_5d", "ret_21d"])


LABELS = "(SELECT symbol, ts, available_at, lead(available_at, 5) OVER w AS label_available_at, lead(close, 5) OVER w / close - 1 AS label FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY lead(close, 5) OVER w IS NOT NULL)"


@query("forward_return_label", f"SELECT * FROM {LABELS}", "label", "ts available_at label_available_at")
def _(spark, sf_dir):
    return labels.forward_labels(derived.bars(spark, sf_dir))


@query("classification_label", f"SELECT symbol, ts, available_at, label_available_at, CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END AS label FROM {LABELS}", "label", "ts available_at label_available_at")
def _(spark, sf_dir):
    return labels.forward_labels(derived.bars(spark, sf_dir), classification=True)


@query("stored_returns_long", " UNION ALL ".join(f"SELECT * FROM (SELECT symbol, ts, {h} AS horizon, 'trailing' AS direction, close / lag(close, {h}) OVER w - 1 AS value, available_at FROM bars WINDOW w AS ({W})) WHERE value IS NOT NULL UNION ALL SELECT * FROM (SELECT symbol, ts, {h}, 'forward', lead(close, {h}) OVER w / close - 1 AS value, lead(available_at, {h}) OVER w FROM bars WINDOW w AS ({W})) WHERE value IS NOT NULL" for h in (1, 5, 21)), "value", "ts available_at")
def _(spark, sf_dir):
    return labels.stored_returns(derived.bars(spark, sf_dir))


def _fold_sql(first: str, embargo: int) -> str:
    placed = f"(SELECT l.*, t.place, t.n FROM {LABELS} l JOIN (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {LABELS})) t USING (ts))"
    bounds = f"(SELECT k AS fold, n, n - (f - k) * 126 AS start, {first} AS first FROM (SELECT n, least(5, (n - 504) // 126) AS f FROM (SELECT count(DISTINCT ts) AS n FROM {LABELS})), range(5) r(k) WHERE k < f)"
    edges = f"(SELECT b.*, t.ts AS test_from FROM {bounds} b JOIN (SELECT DISTINCT ts, place FROM {placed}) t ON t.place = b.start)"
    role = f"CASE WHEN p.place >= e.start THEN 'test' WHEN {embargo} > 0 AND p.ts > e.test_from - INTERVAL {embargo} DAY THEN 'embargoed' WHEN p.label_available_at >= e.test_from THEN 'purged' ELSE 'train' END"
    return f"SELECT CAST(e.fold AS INTEGER) AS fold, {role} AS role, count(*) AS n, min(p.ts) AS first_ts, max(p.ts) AS last_ts FROM {placed} p JOIN {edges} e ON p.place >= e.first AND p.place <= e.start + 125 GROUP BY 1, 2"


def _folds(spark, sf_dir, **how):
    dealt = labels.folds(labels.forward_labels(derived.bars(spark, sf_dir)), **how)
    return dealt.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("expanding_folds", _fold_sql("0", 0), "", "first_ts last_ts")
def _(spark, sf_dir):
    return _folds(spark, sf_dir)


@query("rolling_folds", _fold_sql("greatest(0, n - (f - k) * 126 - 504)", 0), "", "first_ts last_ts")
def _(spark, sf_dir):
    return _folds(spark, sf_dir, kind="rolling")


@query("purge_embargo_counts", _fold_sql("0", 10), "", "first_ts last_ts")
def _(spark, sf_dir):
    return _folds(spark, sf_dir, embargo_days=10)


def _checks_sql(rows: str, entity: str, checks: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {entity} AS entity, '{n}' AS check_name, CAST({o} AS DOUBLE) AS observed, CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status FROM {rows} q" for n, o, ok, bad in checks)


#: Bars whose arrival is now and then late, so that the check of their order has something to find.
_ARRIVAL = "ts + CASE WHEN symbol = '3-MEDIUM' AND day(ts) % 5 = 0 THEN INTERVAL 73 HOUR ELSE INTERVAL 0 HOUR END"
_LAGS = f"""(SELECT *, lag(ts) OVER w AS prev, lag(close) OVER w AS prev_close, date_diff('day', lag(ts) OVER w, ts) AS gap,
  lag(ts) OVER (PARTITION BY symbol ORDER BY arrival) > ts AS back
  FROM (SELECT *, {_ARRIVAL} AS arrival FROM bars) WINDOW w AS ({W}))"""
_SIGNS = " + ".join(f"count(*) FILTER ({x} <= 0)" for x in ("open", "high", "low", "close", "adj_close"))
_ODD = "high < greatest(open, close) OR low > least(open, close) OR high < low"
_GOT = f"""(SELECT symbol, count(*) AS n, count(*) FILTER (prev = ts) AS repeated, count(*) FILTER (back) AS disorder,
  count(*) FILTER (available_at < ts) AS early, count(*) FILTER ({_ODD}) AS odd, {_SIGNS} AS signs, 0.0 AS missing,
  count(*) FILTER (abs(close / prev_close - 1) > 0.5) AS jumps, count(*) FILTER (gap > 7) AS gaps FROM {_LAGS} GROUP BY symbol)"""
_ZERO = [("no_duplicates", "repeated"), ("monotonic_time", "disorder"), ("availability", "early"), ("ohlc_consistency", "odd"), ("positive_prices", "signs")]


@query("quality_price_report", _checks_sql(_GOT, "symbol", [("row_count", "n", "n >= 1", "FAIL"), *((a, b, f"{b} = 0", "FAIL") for a, b in _ZERO), ("missing_values", "missing", "missing <= 0.02", "WARN"), ("extreme_returns", "jumps", "n >= 3 AND jumps = 0", "WARN"), ("calendar_gaps", "gaps", "n >= 3 AND gaps = 0", "WARN")]), "observed")
def _(spark, sf_dir):
    late = (F.col("symbol") == "3-MEDIUM") & (F.dayofmonth("ts") % 5 == 0)
    arrival = F.col("ts") + F.when(late, F.expr("INTERVAL 73 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    return quality.price_report(derived.bars(spark, sf_dir).withColumn("arrival", arrival), arrival="arrival")


_MGOT = "(SELECT code, count(*) AS n, count(*) FILTER (prev = ts) AS repeated, count(*) FILTER (back) AS disorder, count(*) FILTER (available_at < ts) AS early, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM (SELECT *, lag(ts) OVER (PARTITION BY code ORDER BY ts) AS prev, lag(ts) OVER (PARTITION BY code ORDER BY available_at) > ts AS back FROM macro) GROUP BY code)"


@query("quality_macro_report", _checks_sql(_MGOT, "code", [("row_count", "n", "n >= 1", "FAIL"), *((a, b, f"{b} = 0", "FAIL") for a, b in _ZERO[:3]), ("missing_values", "missing", "missing <= 0.2", "WARN")]), "observed")
def _(spark, sf_dir):
    return quality.macro_report(derived.macro(spark, sf_dir))


@query("availability_violations", "SELECT symbol, count(*) FILTER (available_at < ts) AS violations FROM bars GROUP BY symbol")
def _(spark, sf_dir):
    return derived.bars(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("available_at") < F.col("ts")).alias("violations"))


@query("freshness", "SELECT symbol, max(ts) AS newest, CAST(date_diff('day', max(ts), TIMESTAMP '1998-08-10') AS INTEGER) AS age_days, date_diff('day', max(ts), TIMESTAMP '1998-08-10') > 5 AS stale FROM bars GROUP BY symbol", "", "newest")
def _(spark, sf_dir):
    return quality.freshness(derived.bars(spark, sf_dir), F.lit("1998-08-10").cast("date"))


@query("forecast_metrics_by_model", "SELECT model, count(*) AS n, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) ** 2) / sum(y_true ** 2) AS r2_zero, avg(CASE WHEN abs(y_pred) > 1e-12 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END) AS directional_accuracy, CASE WHEN stddev_samp(y_pred) > 1e-12 THEN covar_samp(y_true, y_pred) / (stddev_samp(y_true) * stddev_samp(y_pred)) END AS ic FROM preds GROUP BY model", "mse rmse mae r2_zero directional_accuracy ic")
def _(spark, sf_dir):
    return evaluation.forecast_metrics(derived.predictions(spark, sf_dir), "model")


_RANKS = "(SELECT model, rank() OVER (PARTITION BY model ORDER BY y_true) + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2.0 AS rp FROM preds)"


@query("rank_ic", f"SELECT model, CASE WHEN stddev_samp(rp) > 1e-12 THEN covar_samp(ry, rp) / (stddev_samp(ry) * stddev_samp(rp)) END AS rank_ic FROM {_RANKS} GROUP BY model", "rank_ic")
def _(spark, sf_dir):
    return evaluation.rank_ic(derived.predictions(spark, sf_dir), "model")


_SCORED = "(SELECT model, CASE WHEN y_true > 0 THEN 1 ELSE 0 END AS label, 1 / (1 + exp(-least(30, greatest(-30, y_pred)))) AS score FROM preds)"


def _scored(spark, sf_dir):
    p = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("y_pred")))
    return derived.predictions(spark, sf_dir).select("model", (F.col("y_true") > 0).cast("int").alias("label"), (1 / (1 + F.exp(-p))).alias("score"))


@query("roc_auc", f"SELECT model, (sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM {_SCORED}) GROUP BY model", "auc")
def _(spark, sf_dir):
    return evaluation.roc_auc(_scored(spark, sf_dir), "model")


@query("log_loss_brier", f"SELECT model, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss, avg((label - score) ** 2) AS brier, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, score)) AS p FROM {_SCORED}) GROUP BY model", "log_loss brier accuracy")
def _(spark, sf_dir):
    return evaluation.log_loss_brier(_scored(spark, sf_dir), "model")


_DIFF = "(SELECT a.ts, avg((a.y_true - a.y_pred) ** 2 - (b.y_true - b.y_pred) ** 2) AS d FROM preds a JOIN preds b ON a.symbol = b.symbol AND a.ts = b.ts AND a.model = 'hist21' AND b.model = 'zero' GROUP BY a.ts)"


@query("daily_loss_differential", f"SELECT * FROM {_DIFF}", "d", "ts")
def _(spark, sf_dir):
    return evaluation.daily_loss_differential(derived.predictions(spark, sf_dir), "hist21", "zero")


_DM = f"(SELECT 'd' AS symbol, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n, avg(d) OVER () AS mean, d - avg(d) OVER () AS d FROM {_DIFF})"
_DM_LAGS = f"(SELECT CAST(greatest(4, floor(4 * pow(any_value(n) / 100.0, 2.0 / 9))) AS INTEGER) AS lags FROM {_DM})"
_DM_LRV = f"""(SELECT a.n, a.mean, l.lags, sum(a.d * b.d * CASE WHEN a.i = b.i THEN 1.0 ELSE 2.0 * (1 - (a.i - b.i) / (l.lags + 1.0)) END) / a.n AS lrv
  FROM {_DM} a JOIN {_DM_LAGS} l ON true JOIN {_DM} b ON b.i BETWEEN a.i - l.lags AND a.i GROUP BY a.n, a.mean, l.lags)"""


@query("dm_statistic", f"SELECT *, {student_sql('statistic', '(n - 1)')} AS p FROM (SELECT n, lags, mean, mean / sqrt(greatest(lrv, 1e-300) / n) * sqrt((n + 1 - 10 + 20.0 / n) / n) AS statistic FROM {_DM_LRV} WHERE n >= 10)", "mean statistic p")
def _(spark, sf_dir):
    daily = evaluation.daily_loss_differential(derived.predictions(spark, sf_dir), "hist21", "zero")
    return evaluation.diebold_mariano(daily, horizon=5)


_TESTS = "(SELECT symbol, exp(-abs(avg(r) / stddev_samp(r)) * sqrt(count(*))) AS p FROM rets GROUP BY symbol)"


def _tests(spark, sf_dir):
    r = _returns(spark, sf_dir).where("r is not null")
    return r.groupBy("symbol").agg(F.exp(-F.abs(F.avg("r") / F.stddev_samp("r")) * F.sqrt(F.count(F.lit(1)) + 1)).alias("p"))


@query("bh_adjust", f"SELECT symbol, p, least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM {_TESTS})", "p p_adjusted")
def _(spark, sf_dir):
    return evaluation.adjust_pvalues(_tests(spark, sf_dir))


@query("bonferroni", f"SELECT symbol, p, least(1.0, p * count(*) OVER ()) AS p_adjusted FROM {_TESTS}", "p p_adjusted")
def _(spark, sf_dir):
    return evaluation.adjust_pvalues(_tests(spark, sf_dir), method="bonferroni")


@query("ma_crossover_targets", f"SELECT symbol, ts, CASE WHEN f > s THEN share ELSE 0.0 END AS weight FROM (SELECT symbol, ts, {_full(20, 'close', 'avg(close)')} AS f, {_full(100, 'close', 'avg(close)')} AS s, 1.0 / count(*) OVER (PARTITION BY ts) AS share FROM bars) WHERE s IS NOT NULL", "weight", "ts")
def _(spark, sf_dir):
    return backtest.ma_crossover_targets(derived.bars(spark, sf_dir))


_MOMENTUM = f"(SELECT symbol, ts, CASE WHEN past > 0 THEN share ELSE 0.0 END AS weight FROM (SELECT symbol, ts, close / lag(close, 126) OVER ({W}) - 1 AS past, 1.0 / count(*) OVER (PARTITION BY ts) AS share FROM bars) WHERE past IS NOT NULL)"


@query("ts_momentum_targets", f"SELECT * FROM {_MOMENTUM}", "weight", "ts")
def _(spark, sf_dir):
    return backtest.momentum_targets(derived.bars(spark, sf_dir))


@query("prediction_topk_targets", "SELECT symbol, ts, CASE WHEN chosen THEN 1.0 / sum(CAST(chosen AS INTEGER)) OVER (PARTITION BY ts) ELSE 0.0 END AS weight FROM (SELECT *, y_pred > 0 AND row_number() OVER (PARTITION BY ts ORDER BY (y_pred > 0) DESC, y_pred DESC, symbol) <= 2 AS chosen FROM preds WHERE model = 'hist21')", "weight", "ts")
def _(spark, sf_dir):
    return backtest.prediction_targets(derived.predictions(spark, sf_dir).where("model = 'hist21'"))


@query("next_open_fills", f"SELECT t.symbol, t.ts, t.weight, b.fill_ts, b.fill_price FROM {_MOMENTUM} t JOIN (SELECT symbol, ts, lead(ts) OVER ({W}) AS fill_ts, lead(open) OVER ({W}) AS fill_price FROM bars) b USING (symbol, ts) WHERE fill_price > 0", "weight fill_price", "ts fill_ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    return backtest.next_open_fills(backtest.momentum_targets(b), b)


_SIZED = f"(SELECT t.symbol, t.ts, t.weight, CAST(trunc(greatest(-50 * b.volume, least(50 * b.volume, t.weight * 10000000 / b.close))) AS BIGINT) AS quantity, b.close, b.volume FROM {_MOMENTUM} t JOIN bars b USING (symbol, ts))"


def _sized(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    return backtest.sized_orders(backtest.momentum_targets(b), b, 1e7, participation=50.0), b


@query("sized_orders", f"SELECT symbol, ts, weight, quantity FROM {_SIZED}", "weight", "ts")
def _(spark, sf_dir):
    return _sized(spark, sf_dir)[0]


@query("commission_models", f"SELECT symbol, ts, CASE WHEN quantity * close <> 0 THEN least(greatest(0.005 * abs(quantity), 1.0), 0.01 * abs(quantity * close)) ELSE greatest(0.005 * abs(quantity), 1.0) END AS per_share, greatest(abs(quantity * close) * 5 / 10000, 0.0) AS percent FROM {_SIZED}", "per_share percent", "ts")
def _(spark, sf_dir):
    sized, b = _sized(spark, sf_dir)
    rows = sized.join(b.select("symbol", "ts", "close"), ["symbol", "ts"])
    notional = F.col("quantity") * F.col("close")
    return rows.select("symbol", "ts", backtest.per_share_commission(F.col("quantity"), notional).alias("per_share"), backtest.percent_commission(notional).alias("percent"))


_IMPACT = "coalesce(CASE WHEN sigma > 0 THEN sigma ELSE 0.02 END * sqrt(CASE WHEN volume > 0 THEN least(abs(quantity) / volume, 0.25) END), 0)"
_DAILY = f"(SELECT symbol, ts, CASE WHEN count(r) OVER w = 21 THEN stddev_samp(r) OVER w END AS sigma FROM rets WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"
_PRICED = f"(SELECT symbol, ts, quantity, close, volume, sigma, sign(quantity) AS side FROM {_SIZED} JOIN {_DAILY} USING (symbol, ts))"


def _priced(spark, sf_dir):
    sized, b = _sized(spark, sf_dir)
    daily = _returns(spark, sf_dir).select("symbol", "ts", c.rolling_std(F.col("r"), 21).alias("sigma"))
    return sized.join(b.select("symbol", "ts", F.col("close").alias("price"), "volume"), ["symbol", "ts"]).join(daily, ["symbol", "ts"])


@query("slippage_models", f"""SELECT symbol, ts, close * (1 + side * 5.0 / 10000) AS fixed, close * (1 + side * (2.5 / 10000 + {_IMPACT})) AS impact FROM {_PRICED}""", "fixed impact", "ts")
def _(spark, sf_dir):
    price, side, quantity = F.col("price"), F.signum("quantity"), F.col("quantity")
    impact = backtest.impact_slippage(price, side, quantity, F.col("volume"), F.col("sigma"))
    return _priced(spark, sf_dir).select("symbol", "ts", backtest.fixed_slippage(price, side).alias("fixed"), impact.alias("impact"))


_PESSIMISTIC = f"close * (1 + side * (5.0 / 10000 + {_IMPACT}))"
_CHARGED = f"""(SELECT symbol, 'frictionless' AS scenario, quantity, close, close AS filled, 0.0 AS rate FROM {_PRICED} UNION ALL
  SELECT symbol, 'realistic', quantity, close, close * (1 + side * 5.0 / 10000), 0.005 FROM {_PRICED} UNION ALL SELECT symbol, 'pessimistic', quantity, close, {_PESSIMISTIC}, 0.01 FROM {_PRICED})"""


@query("trade_costs_by_scenario", f"""SELECT symbol, scenario, count(*) FILTER (quantity <> 0) AS trades, sum(abs(quantity * close)) AS notional,
    sum(CASE WHEN quantity = 0 OR rate = 0 THEN 0 ELSE least(greatest(rate * abs(quantity), 1.0), 0.01 * abs(quantity * filled)) END) AS commission,
    sum(abs(quantity) * abs(filled - close)) AS slippage FROM {_CHARGED} GROUP BY symbol, scenario""", "notional commission slippage")  # fmt: skip
def _(spark, sf_dir):
    rows = _priced(spark, sf_dir)
    costs = [backtest.trade_costs(rows, k).withColumn("scenario", F.lit(k)) for k in backtest.COSTS]
    return costs[0].unionByName(costs[1]).unionByName(costs[2])


@query("orders_in_lots", f"SELECT symbol, ts, weight, CAST(sign(raw) * floor(abs(raw) / 100) * 100 AS BIGINT) AS quantity FROM (SELECT t.symbol, t.ts, t.weight, t.weight * 10000000 / b.close AS raw FROM {_MOMENTUM} t JOIN bars b USING (symbol, ts))", "weight", "ts")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    return backtest.sized_orders(backtest.momentum_targets(b), b, 1e7, participation=None, lot=100)


@query("rebalance_calendar", "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, min(ts) AS ts FROM bars GROUP BY 1", "", "period ts")
def _(spark, sf_dir):
    return backtest.rebalance_dates(derived.bars(spark, sf_dir))


@query("equity_metrics", f"""SELECT symbol, n, growth - 1 AS total_return, pow(growth, 1 / years) - 1 AS cagr, sd * sqrt(252) AS volatility, mean / sd * sqrt(252) AS sharpe, mean / down * sqrt(252) AS sortino, mdd AS max_drawdown, wins AS win_rate, gains / losses AS profit_factor, (pow(growth, 1 / years) - 1) / abs(mdd) AS calmar FROM (
  SELECT symbol, count(*) AS n, arg_max(close, ts) / arg_min(close, ts) AS growth, date_diff('second', min(ts), max(ts)) / (365.25 * 86400) AS years, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(CASE WHEN r < 0 THEN r * r END)) AS down, min(dd) AS mdd, avg(CASE WHEN abs(r) > 1e-12 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END END) AS wins, sum(CASE WHEN r > 0 THEN r END) AS gains, -sum(CASE WHEN r < 0 THEN r END) AS losses
  FROM (SELECT *, close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rets) GROUP BY symbol)""", "total_return cagr volatility sharpe sortino max_drawdown win_rate profit_factor calmar")
def _(spark, sf_dir):
    return backtest.equity_metrics(derived.bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("equity")), "symbol")


_Z = -1.6448536269514722


@query("value_at_risk", f"SELECT symbol, n, historical, mean + {_Z} * sd AS parametric, mean + ({_Z} + ({_Z} ** 2 - 1) * s / 6 + ({_Z} ** 3 - 3 * {_Z}) * k / 24 - (2 * {_Z} ** 3 - 5 * {_Z}) * s ** 2 / 36) * sd AS cornish_fisher, cvar FROM (SELECT symbol, count(*) AS n, any_value(h) AS historical, avg(r) AS mean, stddev_samp(r) AS sd, (avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / var_pop(r) ** 1.5 AS s, kurtosis_pop(r) AS k, avg(CASE WHEN r <= h THEN r END) AS cvar FROM (SELECT symbol, r, quantile_cont(r, 0.05) OVER (PARTITION BY symbol) AS h FROM rets WHERE r IS NOT NULL) GROUP BY symbol)", "historical parametric cornish_fisher cvar")
def _(spark, sf_dir):
    return risk.value_at_risk(_returns(spark, sf_dir))


_MOMENTS = """(SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.95) AS q95,
  (avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / var_pop(r) ** 1.5 AS skew, kurtosis_pop(r) AS kurtosis, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive
  FROM rets WHERE r IS NOT NULL GROUP BY symbol)"""
_JB = "n / 6.0 * (skew ** 2 + kurtosis ** 2 / 4)"


@query("return_description", f"SELECT *, {_JB} AS jarque_bera, exp(-({_JB}) / 2) AS jb_p FROM {_MOMENTS}", "mean sd q05 q50 q95 skew kurtosis positive jarque_bera jb_p")
def _(spark, sf_dir):
    return risk.describe(_returns(spark, sf_dir))


@query("correlation_covariance", "SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.r, b.r) * 252 AS covariance, corr(a.r, b.r) AS correlation FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol <= b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2", "covariance correlation")
def _(spark, sf_dir):
    return risk.pairwise(_returns(spark, sf_dir))


@query("autocorrelation_ljung_box", "SELECT symbol, n, CAST(lag AS INTEGER) AS lag, acf, n * (n + 2) * sum(acf ** 2 / (n - lag)) OVER (PARTITION BY symbol ORDER BY lag ROWS UNBOUNDED PRECEDING) AS ljung_box FROM (" + " UNION ALL ".join(f"SELECT symbol, count(*) AS n, {k} AS lag, sum(e * p) / sum(e * e) AS acf FROM (SELECT symbol, e, lag(e, {k}) OVER ({W}) AS p FROM (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS e FROM rets WHERE r IS NOT NULL)) GROUP BY symbol" for k in range(1, 6)) + ")", "acf ljung_box")
def _(spark, sf_dir):
    return risk.autocorrelation(_returns(spark, sf_dir))


@query("inverse_volatility_weights", "SELECT symbol, (1 / sd) / sum(1 / sd) OVER () AS weight FROM (SELECT symbol, stddev_samp(r) AS sd FROM rets GROUP BY symbol)", "weight")
def _(spark, sf_dir):
    return risk.inverse_volatility(_returns(spark, sf_dir))


@query("intraday_bars", "SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS ticks FROM events GROUP BY 1, 2", "open high low close", "start")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    from .streaming.bars import tick_bars

    return tick_bars(events, "1 hour")


NUMBERED = "(SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, avg(r) OVER (PARTITION BY symbol) AS mean, r - avg(r) OVER (PARTITION BY symbol) AS d FROM rets WHERE r IS NOT NULL)"


def _long_run_sql(lags: str) -> str:
    """Long-run variances per symbol up to the lags that a subquery (symbol, lags) gives."""
    return f"(SELECT a.symbol, a.n, a.mean, l.lags, sum(a.d * b.d * CASE WHEN a.i = b.i THEN 1.0 ELSE 2.0 * (1 - (a.i - b.i) / (l.lags + 1.0)) END) / a.n AS lrv FROM {NUMBERED} a JOIN {lags} l ON a.symbol = l.symbol JOIN {NUMBERED} b ON a.symbol = b.symbol AND b.i BETWEEN a.i - l.lags AND a.i GROUP BY a.symbol, a.n, a.mean, l.lags)"


_NW_LAGS = f"(SELECT symbol, CAST(greatest(1, floor(4 * pow(any_value(n) / 100.0, 2.0 / 9))) AS INTEGER) AS lags FROM {NUMBERED} GROUP BY symbol)"


@query("hac_mean_test", f"SELECT symbol, n, mean, lags, mean / sqrt(lrv / n) AS t FROM {_long_run_sql(_NW_LAGS)}", "mean t")
def _(spark, sf_dir):
    return inference.hac_mean_test(_returns(spark, sf_dir))


_KPSS_SHAPE = f"(SELECT a.symbol, any_value(a.n) AS n, sum(a.d * b.d * CASE WHEN a.i = b.i THEN 1.0 ELSE 2.0 END) AS s0, sum(2.0 * (a.i - b.i) * a.d * b.d) AS s1 FROM {NUMBERED} a JOIN {NUMBERED} b ON a.symbol = b.symbol AND b.i BETWEEN a.i - CAST(floor(pow(a.n, 2.0 / 9)) AS INTEGER) AND a.i GROUP BY a.symbol)"
_KPSS_LAGS = f"(SELECT symbol, least(CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)) AS INTEGER), CAST(n - 1 AS INTEGER)) AS lags FROM {_KPSS_SHAPE})"


_KPSS_STEPS = " ".join(
    f"WHEN statistic <= {b} THEN {pa} + ({pb} - {pa}) * (statistic - {a}) / ({b} - {a})"
    for a, b, pa, pb in zip(inference.KPSS_CRITICAL, inference.KPSS_CRITICAL[1:], inference.KPSS_P, inference.KPSS_P[1:])
)
_KPSS_SUMS = f"(SELECT symbol, sum(s * s) AS eta FROM (SELECT symbol, sum(d) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM {NUMBERED}) GROUP BY symbol)"
_KPSS = f"(SELECT l.symbol, l.n, l.lags, e.eta / (l.n * l.n * l.lrv) AS statistic FROM {_long_run_sql(_KPSS_LAGS)} l JOIN {_KPSS_SUMS} e ON l.symbol = e.symbol)"


@query("kpss_statistic", f"SELECT *, CASE WHEN statistic <= {inference.KPSS_CRITICAL[0]} THEN {inference.KPSS_P[0]} {_KPSS_STEPS} ELSE {inference.KPSS_P[-1]} END AS p FROM {_KPSS}", "statistic p")
def _(spark, sf_dir):
    return inference.kpss_test(_returns(spark, sf_dir))


_NORMAL = NormalDist()
_TRIALS = len(SYMBOLS)
_LUCK = (1 - inference.EULER) * _NORMAL.inv_cdf(1 - 1 / _TRIALS) + inference.EULER * _NORMAL.inv_cdf(1 - 1 / (_TRIALS * math.e))
_RATIOS = "(SELECT symbol, count(r) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1.0)) AS s, kurtosis_pop(r) + 3 AS k FROM rets WHERE r IS NOT NULL GROUP BY symbol)"
_SHAPED = f"(SELECT *, greatest(1 - s * sr + (k - 1) / 4 * sr ** 2, 1e-12) AS shape, {_LUCK} * stddev_samp(sr) OVER () AS luck FROM {_RATIOS})"
_SHARPES = f"(SELECT *, sr * sqrt(n - 1) / sqrt(shape) AS z, (sr - luck) * sqrt(n - 1) / sqrt(shape) AS zl FROM {_SHAPED})"


@query("sharpe_inference", f"""SELECT symbol, n, sr * sqrt(252) AS sharpe, {normal_sql('z')} AS psr, luck * sqrt(252) AS expected_max, {normal_sql('zl')} AS dsr,
    CASE WHEN sr > 0 THEN (1 + shape * ({_NORMAL.inv_cdf(0.95)} / sr) ** 2) / 252 END AS min_track_record_years FROM {_SHARPES}""", "sharpe psr expected_max dsr min_track_record_years")  # fmt: skip
def _(spark, sf_dir):
    return inference.sharpe_inference(_returns(spark, sf_dir))


CUT = "1998-01-01"
_RIDGE = f"""WITH f AS (SELECT symbol, ts, r AS x1, close / lag(close, 5) OVER w - 1 AS x2, lead(close, 1) OVER w / close - 1 AS y FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  known AS (SELECT * FROM f WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
  t AS (SELECT symbol, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12 FROM known WHERE ts < TIMESTAMP '{CUT}' GROUP BY symbol HAVING count(*) >= {models.LEAST_ROWS}),
  g AS (SELECT *, n + 1.0 AS a, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS b1, n * c2 / s2 AS b2 FROM t),
  k AS (SELECT symbol, my, m1, m2, (b1 * a - b2 * o) / (a * a - o * o) / s1 AS k1, (b2 * a - b1 * o) / (a * a - o * o) / s2 AS k2 FROM g)
  SELECT known.symbol, known.ts, my + k1 * (x1 - m1) + k2 * (x2 - m2) AS y_pred, y AS y_true FROM known JOIN k ON known.symbol = k.symbol WHERE ts >= TIMESTAMP '{CUT}'"""


@query("ridge_forecast", _RIDGE, "y_pred y_true", "ts")
def _(spark, sf_dir):
    p = F.col("close")
    rows = derived.bars(spark, sf_dir).select("symbol", "ts", c.pct_change(p).alias("x1"), c.pct_change(p, 5).alias("x2"), (F.lead(p).over(c.W.partitionBy("symbol").orderBy("ts")) / p - 1).alias("y_true")).dropna()
    fitted = models.fit(rows.where(F.col("ts") < CUT), ["x1", "x2"], "y_true", "symbol", models.ridge, alpha=1.0)
    return models.predict(rows.where(F.col("ts") >= CUT), fitted, ["x1", "x2"], "symbol").select("symbol", "ts", "y_pred", "y_true")


@query("walk_forward_models")
def _(spark, sf_dir):
    b = derived.bars(spark, sf_dir)
    x = b.select("symbol", "ts", c.pct_change(F.col("close")).alias("ret_1d"), c.pct_change(F.col("close"), 21).alias("ret_21d"))
    return models.walk_forward(labels.folds(labels.forward_labels(b, 1).join(x, ["symbol", "ts"]).dropna()), ["ret_1d", "ret_21d"])


@query("portfolio_weights")
def _(spark, sf_dir):
    monthly = derived.bars(spark, sf_dir).groupBy("symbol", F.date_trunc("month", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    return portfolio.weights(monthly.select("symbol", "ts", c.pct_change(F.col("close")).alias("r")).where("r is not null"), SYMBOLS)


from . import catalog_execution, catalog_research, catalog_streams, catalog_studies, catalog_trades  # noqa: E402, F401  (register their queries)
