"""Causal functions on hand-made series, and their guards."""

from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import causal as c
from tidemark.operators import backtest, labels, relational
from tidemark.streaming.bars import tick_bars


@pytest.fixture(scope="module")
def bars(spark):
    days = pd.date_range("2020-01-01", periods=60, freq="D")
    close = [100 + (k * 7919 % 23) - (k * 31 % 11) for k in range(60)]
    pdf = pd.DataFrame({"symbol": "A", "ts": days, "available_at": days + pd.Timedelta("21h"), "open": close, "high": [x + 1 for x in close], "low": [x - 1 for x in close], "close": close, "adj_close": close, "volume": 10.0})
    return spark.createDataFrame(pdf.astype({k: float for k in ("open", "high", "low", "close", "adj_close")}))


@pytest.mark.parametrize("n", [0, -1])
def test_future_windows_are_refused(spark, n):
    for f in (c.lag, c.pct_change, c.rolling_mean, c.forward_return):
        with pytest.raises(c.LookAheadError):
            f(F.lit(1), n)


def test_windows_equal_pandas(spark, bars):
    x = F.col("close")
    got = bars.select("ts", c.rolling_skew(x, 21).alias("skew"), c.rolling_kurtosis(x, 21).alias("kurt"), c.rolling_std(x, 21).alias("std")).toPandas().sort_values("ts").reset_index(drop=True)
    own = bars.toPandas().sort_values("ts").close.reset_index(drop=True).rolling(21)
    for name, want in (("skew", own.skew()), ("kurt", own.kurt()), ("std", own.std())):
        pd.testing.assert_series_equal(got[name], want, check_names=False, rtol=1e-9)


def test_rsi_and_ewm(spark, bars):
    got = c.rsi(c.ewm_mean(bars, "close", 10), "close").toPandas().sort_values("ts").reset_index(drop=True)
    close = bars.toPandas().sort_values("ts").close.reset_index(drop=True)
    pd.testing.assert_series_equal(got["ewm"], close.ewm(span=10, adjust=False, min_periods=10).mean(), check_names=False)
    gain, loss = (close.diff().clip(lower=0), (-close.diff()).clip(lower=0))
    ratio = gain.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / loss.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    pd.testing.assert_series_equal(got.rsi, 100 - 100 / (1 + ratio), check_names=False)


def test_features_do_not_see_the_future(spark, bars):
    cut = datetime(2020, 2, 10)
    bent = bars.withColumn("close", F.when(F.col("ts") > F.lit(cut), -3 * F.col("close")).otherwise(F.col("close")))
    columns = [c.pct_change(F.col("close"), 5).alias("a"), c.rolling_zscore(F.col("close"), 10).alias("b"), c.drawdown(F.col("close")).alias("d")]
    one, two = (d.select("symbol", "ts", *columns).where(F.col("ts") <= F.lit(cut)) for d in (bars, bent))
    assert one.exceptAll(two).count() == 0
    leaky = c.forward_return(F.col("close"), 1).alias("x")
    one, two = (d.select("symbol", "ts", leaky).where(F.col("ts") <= F.lit(cut)) for d in (bars, bent))
    assert one.exceptAll(two).count() == 1


def test_as_of(spark, bars):
    assert relational.as_of_filter(bars, datetime(2020, 1, 2, 20, tzinfo=timezone.utc)).count() == 1
    with pytest.raises(ValueError):
        relational.as_of_filter(bars, datetime(2020, 1, 2))
    with pytest.raises(ValueError):
        relational.as_of_filter(bars.drop("available_at"), "2020-01-02")


def test_asof_join_keeps_null_values(spark, bars):
    macro = spark.createDataFrame([(datetime(2020, 1, 5), 1.0), (datetime(2020, 1, 10), None)], "available_at timestamp, value double")
    got = {r.ts.day: r.m for r in relational.asof_join(bars.where("ts < '2020-01-20'"), macro, "value", "m").collect()}
    assert got[3] is None and got[5] == 1.0 and got[9] == 1.0 and got[10] is None


def test_fold_bounds():
    assert labels.fold_bounds(1134, "expanding") == [(k, 0, 504 + 126 * k, 504 + 126 * k + 125) for k in range(5)]
    assert labels.fold_bounds(1134, "rolling")[2] == (2, 252, 756, 881)
    assert labels.fold_bounds(100) == []


def test_costs_and_targets(spark, bars):
    row = spark.range(1).select(
        backtest.per_share_commission(F.lit(100), F.lit(10_000.0)).alias("a"), backtest.per_share_commission(F.lit(10), F.lit(20.0)).alias("b"), backtest.fixed_slippage(F.lit(100.0), F.lit(-1)).alias("s")
    ).first()
    assert (row.a, row.b) == (1.0, 0.2) and row.s == pytest.approx(99.95)
    fills = backtest.next_open_fills(backtest.momentum_targets(bars, 5), bars)
    assert fills.where("fill_ts <= ts").count() == 0 and fills.count() == 54


def test_stream_bars_equal_batch(spark, tmp_path):
    ticks = spark.createDataFrame([("A", datetime(2020, 1, d, h), float(d * h)) for d in (1, 2, 9, 20) for h in (1, 5, 9)], "symbol string, ts timestamp, value double")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = tick_bars(stream).writeStream.format("memory").queryName("tick_bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("tick_bars")
    assert got.count() == 3 and got.exceptAll(tick_bars(ticks)).count() == 0


@pytest.mark.parametrize("gap", [1, 2, 21, 100, 500])
@pytest.mark.parametrize("alphas", [(2 / 501, 2 / 253, 0.01), (2 / 64, 0.5, 0.97, 1.0)])
def test_ewm_of_sparse_series_equals_pandas(spark, gap, alphas):
    rng = np.random.default_rng(gap)
    n = 2600
    frame = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2000-01-01", periods=n)})
    frame["x"] = np.where(np.arange(n) % gap == gap // 2, 100 + rng.normal(size=n).cumsum(), np.nan)
    frame["y"] = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    frame["one"] = np.where(frame.x.notna(), 1.0, np.nan)
    df = spark.createDataFrame(frame).withColumns({k: F.nanvl(k, F.lit(None)) for k in ("x", "y", "one")})
    sources = {f"{k}_{i}": (k, alpha, 1 + 2 * i) for i, alpha in enumerate(alphas) for k in ("x", "y", "one")}
    got = c.ewm(df, sources).orderBy("ts").toPandas()
    for name, (k, alpha, least) in sources.items():
        want = frame[k].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_one_pass_gives_what_two_give(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(size=300).cumsum()
    frame = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2000-01-01", periods=300), "high": close + 1, "low": close - 1, "close": close})
    df = spark.createDataFrame(frame)
    both = c.rsi_and_range(df, "close", 14, "r", "t").orderBy("ts").toPandas()
    one = c.average_true_range(c.rsi(df, "close", 14, "r"), 14, "t").orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(both[one.columns], one)
