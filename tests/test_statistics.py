"""Aggregates of any statistic, rules with memory and Kendall's tau against plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.causal import LookAheadError
from tidemark.operators import guards, kendall, statistics, strategies

T0 = dt.datetime(2020, 1, 1)
DAY = dt.timedelta(days=1)


def series(spark, n=80, symbols="ab", seed=1):
    rng = random.Random(seed)
    rows = [(s, T0 + i * DAY, None if rng.random() < 0.05 else rng.gauss(0, 0.02)) for s in symbols for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, r double")


def finite(rows, symbol):
    return np.array([r for s, _, r in sorted(rows, key=lambda x: x[:2]) if s == symbol and r is not None])


def test_statistics_of_groups_and_trailing_rows(spark):
    rows, df = series(spark)
    got = df.groupBy("symbol").agg(statistics.statistic(np.median)(F.col("r"), F.col("ts")).alias("median"), statistics.statistic(statistics.max_drawdown)(F.col("r"), F.col("ts")).alias("fall"))
    for r in got.collect():
        x = finite(rows, r.symbol)
        assert r.median == pytest.approx(np.median(x)) and r.fall == pytest.approx(statistics.max_drawdown(x))
    rolled = statistics.rolling_statistic(df, np.median, "r", 5, "m").where("symbol = 'a'").orderBy("ts").toPandas()
    np.testing.assert_allclose(rolled.m, rolled.r.rolling(5).median(), equal_nan=True)
    curve = np.cumprod(1 + finite(rows, "a"))
    assert statistics.max_drawdown(finite(rows, "a")) == pytest.approx(min(curve[j] / max(1.0, *curve[: j + 1]) - 1 for j in range(len(curve))))


@pytest.mark.parametrize("fn", [np.median, statistics.max_drawdown])
def test_bootstrap_of_any_statistic_equals_a_loop(spark, fn, monkeypatch):
    monkeypatch.setattr(statistics, "TASK_DRAWS", 7)
    rows, df = series(spark)
    short = spark.createDataFrame([("short", T0 + i * DAY, 0.1) for i in range(29)] + [("a", T0, float("nan")), ("a", T0, float("inf"))], df.schema)
    got = {r.symbol: r for r in statistics.bootstrap_statistic(df.union(short), fn, draws=20, mean_block=5, seed=4).collect()}
    assert set(got) == {"a", "b"}
    for s, r in got.items():
        x = finite(rows, s)
        draws = []
        for k in range(20):
            rng = np.random.default_rng([4, k])
            fresh = rng.random(len(x)) < 1 / 5
            starts, places, at = iter(rng.integers(0, len(x), 1 + fresh[1:].sum())), [], 0
            for i in range(len(x)):
                at = next(starts) if i == 0 or fresh[i] else (at + 1) % len(x)
                places.append(at)
            draws.append(fn(x[places]))
        assert (r.n, r.drawn, r.point) == (len(x), 20, pytest.approx(fn(x)))
        assert [r.lower, r.upper] == pytest.approx(np.quantile(draws, [0.025, 0.975]).tolist())
        assert r.spread == pytest.approx(np.std(draws, ddof=1)) and r.share_above_zero == pytest.approx(np.mean(np.array(draws) > 0))


def walk(spark, n=150, symbols="abc"):
    rng = random.Random(2)
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(n):
            price *= 1 + rng.gauss(0, 0.03)
            rows.append((s, T0 + i * DAY, T0 + i * DAY + dt.timedelta(hours=21), None if rng.random() < 0.03 else price))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, available_at timestamp, close double")


def test_rule_with_memory_equals_a_loop(spark):
    rows, bars = walk(spark)
    got = strategies.rule_targets(bars, lambda: strategies.TrailingStop(10, 0.05))
    assert got.columns == ["symbol", "ts", "decided_at", "weight"]
    want = []
    for s in "abc":
        past, top = [], None
        for i, (_, ts, known, close) in enumerate(sorted(r for r in rows if r[0] == s)):
            if close is None:
                continue
            if top is not None:
                top = max(top, close)
                if close < top * 0.95:
                    top = None
            elif len(past) >= 10 and close > max(past[-10:]):
                top = close
            past.append(close)
            if i >= 10:
                want.append((s, ts, known, 0.0 if top is None else 1.0))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < sum(r[3] for r in want) < len(want)
    assert strategies.rule_targets(bars.limit(0), strategies.TrailingStop).count() == 0


class Follow(strategies.Rule):
    def on_bar(self, bar):
        return bar["hint"]


def test_guards_find_a_rule_that_peeks(spark):
    _, bars = walk(spark, 60, "a")
    bars = bars.fillna(100.0).withColumn("adj_close", F.col("close"))

    def stop(df):
        return strategies.rule_targets(df, lambda: strategies.TrailingStop(5, 0.05)).select("symbol", "ts", "weight")

    def peek(df):
        from pyspark.sql import Window

        ahead = F.lead("close").over(Window.partitionBy("symbol").orderBy("ts"))
        hinted = df.withColumn("hint", F.coalesce(ahead / F.col("close") - 1, F.lit(0.0)))
        return strategies.rule_targets(hinted, Follow).select("symbol", "ts", "weight")

    guards.assert_causal(stop, bars)
    with pytest.raises(LookAheadError):
        guards.assert_causal(peek, bars)


@pytest.mark.parametrize("chunk_rows", [10**6, 40])
def test_kendall_equals_pairs_of_rows(spark, chunk_rows):
    rng = np.random.default_rng(chunk_rows)
    n = 400
    x = rng.normal(size=n)
    frame = pd.DataFrame({
        "x": x, "y": x + rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float), "hot": np.where(rng.random(n) < 0.6, 1.0, rng.normal(size=n)),
        "gaps": np.where(rng.random(n) < 0.2, np.nan, -x), "same": 5.0, "none": np.nan,
    })
    columns = list(frame)
    got = {(r.a, r.b): r for r in kendall.kendall(spark.createDataFrame(frame), columns, chunk_rows).collect()}
    assert len(got) == len(columns) ** 2
    for a in columns:
        for b in columns:
            both = frame[[a, b]].dropna().to_numpy() if a != b else frame[[a]].dropna().to_numpy()[:, [0, 0]]
            u, v = both.T
            s, t = np.sign(u[:, None] - u[None, :]), np.sign(v[:, None] - v[None, :])
            scale = (np.abs(s).sum() * np.abs(t).sum()) ** 0.5
            r = got[a, b]
            assert r.n == len(u)
            assert r.tau == (pytest.approx((s * t).sum() / scale, abs=1e-12) if scale else None), (a, b)


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        y = rng.integers(0, 20, n)
        assert kendall.inversions(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))
    assert kendall.inversions(np.arange(200_000)[::-1]) == 200_000 * 199_999 // 2
