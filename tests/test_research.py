"""Models, portfolio weights and series tests against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, models, portfolio


def frame(spark, values, names=("a", "b")):
    start = dt.datetime(2020, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), float(x)) for s, column in zip(names, values.T) for i, x in enumerate(column)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, r double")


def test_fits_equal_numpy(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0.2, 3.0]])
    y = x @ [0.5, 0.0, -0.2] + g.normal(size=200)
    rows = spark.createDataFrame([("s", *map(float, (*a, b))) for a, b in zip(x, y)], "g string, x0 double, x1 double, x2 double, y double")
    z = (x - x.mean(0)) / x.std(0)
    names = ["x0", "x1", "x2"]
    got = models.fit(rows, names, "y", "g", models.ridge, alpha=2.0).first()
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    np.testing.assert_allclose(got.coefficients, want, rtol=1e-9)
    assert got.intercept == pytest.approx(y.mean() - want @ x.mean(0))
    w = np.array(models.fit(rows, names, "y", "g", models.elastic_net, alpha=0.1).first().coefficients) * x.std(0)
    slope = z.T @ (y - y.mean() - z @ w) / 200 - 0.05 * w
    for s, v in zip(slope, w):
        assert abs(s) <= 0.05 + 1e-8 and (v == 0 or abs(s - 0.05 * np.sign(v)) < 1e-8)
    assert models.fit(rows.limit(5), names, "y", "g").count() == 0


def test_portfolios(spark):
    g = np.random.default_rng(2)
    r = g.normal(0.01, 1, size=(300, 4)) * [0.01, 0.02, 0.03, 0.05]
    r[:, 3] += 2 * r[:, 0]
    mean, cov, intensity = portfolio.shrunk_covariance(frame(spark, r, "abcd"), list("abcd"))
    sample = np.cov(r.T, ddof=0)
    assert 0 <= intensity <= 1
    np.testing.assert_allclose(cov, (1 - intensity) * sample + intensity * np.trace(sample) / 4 * np.eye(4), rtol=1e-8)
    w = portfolio.minimum_variance(cov)
    slope = cov @ w
    assert w.sum() == pytest.approx(1) and w.min() >= 0
    assert np.all(slope >= slope[w > 0].max() * (1 - 1e-8))
    np.testing.assert_allclose(portfolio.risk_contributions(portfolio.risk_parity(cov), cov), 0.25, rtol=1e-6)
    best = portfolio.maximum_sharpe(cov, mean)
    ratio = lambda v: v @ mean / math.sqrt(v @ cov @ v)
    assert all(ratio(best) >= ratio(v) - 1e-12 for v in g.dirichlet(np.ones(4), 500))


def test_series_tests(spark):
    g = np.random.default_rng(3)
    r = np.stack([g.normal(0.1, 1, 150), g.normal(size=150).cumsum()], axis=1)
    df = frame(spark, r)
    means = {x.symbol: x for x in inference.hac_mean_test(df).collect()}
    d = r[:, 0] - r[:, 0].mean()
    lags = max(1, math.floor(4 * 1.5 ** (2 / 9)))
    lrv = d @ d / 150 + sum(2 * (1 - k / (lags + 1)) * (d[k:] @ d[:-k]) / 150 for k in range(1, lags + 1))
    assert means["a"].lags == lags and means["a"].t == pytest.approx(r[:, 0].mean() / math.sqrt(lrv / 150))
    kpss = {x.symbol: x for x in inference.kpss_test(df).collect()}
    assert kpss["a"].p > 0.05 and kpss["b"].p < 0.05
    sharpe = {x.symbol: x for x in inference.sharpe_inference(df).collect()}
    assert sharpe["a"].dsr <= sharpe["a"].psr and sharpe["a"].min_track_record_years > 0
    assert inference.hac_mean_test(df.limit(0)).count() == 0


def test_student_p():
    """Two-sided tails from printed tables."""
    for t, df, p in ((2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (0.0, 7, 1.0), (3.169, 10, 0.01), (-2.0, 60, 0.05)):
        assert inference._student_tail(t, df) == pytest.approx(p, abs=2e-4)


def test_diebold_mariano(spark):
    from tidemark.operators import evaluation

    g = np.random.default_rng(4)
    d = g.normal(0.2, 1, 80)
    start = dt.datetime(2020, 1, 1)
    rows = spark.createDataFrame([(start + dt.timedelta(days=i), float(x)) for i, x in enumerate(d)], "ts timestamp, d double")
    got = evaluation.diebold_mariano(rows, horizon=3, lags=2).first()
    e = d - d.mean()
    lrv = e @ e / 80 + sum(2 * (1 - k / 3) * (e[k:] @ e[:-k]) / 80 for k in (1, 2))
    factor = math.sqrt((80 + 1 - 6 + 6 / 80) / 80)
    assert got.statistic == pytest.approx(d.mean() / math.sqrt(lrv / 80) * factor)
    assert got.p == pytest.approx(inference._student_tail(got.statistic, 79)) and got.lags == 2
    assert evaluation.diebold_mariano(rows, horizon=6).first().lags == 5
    assert evaluation.diebold_mariano(rows.limit(9)).count() == 0
    with pytest.raises(ValueError):
        evaluation.diebold_mariano(rows, horizon=0)


def test_adjusted_p_values(spark):
    from tidemark.operators import evaluation

    p = [0.01, 0.04, 0.03, 0.03, 0.5, None]
    rows = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [r.p_adjusted for r in evaluation.adjust_pvalues(rows).orderBy("i").collect()]
    assert got[:5] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5]) and got[5] is None


def test_order_and_drawdowns(spark):
    from tidemark.operators import backtest, quality

    day = lambda n: dt.datetime(2020, 1, n)
    bar = lambda n, at: ("A", day(n), day(n) + dt.timedelta(hours=21), at, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    names = "symbol string, ts timestamp, available_at timestamp, arrival int, open double, high double, low double, close double, adj_close double, volume double"
    bars = spark.createDataFrame([bar(3, 1), bar(1, 2), bar(2, 3)], names)
    status = {r.check_name: r.status for r in quality.price_report(bars, arrival="arrival").collect()}
    assert status["monotonic_time"] == "FAIL" and status["no_duplicates"] == "PASS"
    assert {r.check_name: r.status for r in quality.price_report(bars).collect()}["monotonic_time"] == "PASS"
    with pytest.raises(quality.StaleData):
        quality.assert_fresh(bars, F.lit(dt.date(2020, 1, 20)))
    assert quality.assert_fresh(bars, F.lit(dt.date(2020, 1, 5))) is bars
    newer = bars.union(bars.where("arrival = 1").withColumns({"symbol": F.lit("B"), "ts": F.lit(day(20))}))
    with pytest.warns(UserWarning, match="1 stale symbols: A 19 days"):  # one stale symbol does not hold up the others
        assert quality.assert_fresh(newer, F.lit(dt.date(2020, 1, 22))) is newer
    with pytest.raises(quality.StaleData, match="no rows"):
        quality.assert_fresh(bars.limit(0), F.lit(dt.date(2020, 1, 22)))
    curve = spark.createDataFrame([("x", day(i + 1), v) for i, v in enumerate([100.0, 90.0, 80.0, 100.0, 99.0, 120.0, 60.0])], "run string, ts timestamp, equity double")
    got = [(r.start.day, r.trough_ts.day, r.end.day, round(r.depth, 6), r.length, r.underwater) for r in backtest.drawdown_episodes(curve).orderBy("place").collect()]
    assert got == [(7, 7, 7, -0.5, 1, 1), (2, 3, 4, -0.2, 3, 2), (5, 5, 6, -0.01, 2, 1)]


def test_ewm_over_many_chunks_and_gaps(spark):
    import pandas as pd

    from tidemark.functions import causal

    g = np.random.default_rng(5)
    x = g.normal(size=2000).cumsum() + 50
    x[[0, 1, 700, 701, 702]] = np.nan
    x[900:1500] = np.nan
    rows = [("s", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), None if math.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    got = causal.ewm(df, {"a": ("x", 2 / 22, 21), "b": ("x", 0.5, 1), "c": ("x", 1.0, 1)}).toPandas().sort_values("ts")
    for name, alpha, least in (("a", 2 / 22, 21), ("b", 0.5, 1), ("c", 1.0, 1)):
        want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want, rtol=1e-10)


def test_upsert_batches(spark, tmp_path):
    from tidemark.streaming.bars import upsert_batches

    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 5, 3.0), ("b", 4, 9.0)]
    spark.createDataFrame(rows, "k string, ingest_seq int, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ingest_seq int, v double").parquet(str(tmp_path / "in"))
    upsert_batches(stream, ["k"], lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2.0), ("b", 3.0)]


def test_costs_sizes_and_sides_by_hand(spark):
    from tidemark.operators import backtest

    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("double")

    def impact(quantity, volume, sigma, side=1):
        return one.select(backtest.impact_slippage(lit(100.0), lit(side), lit(quantity), lit(volume), lit(sigma))).first()[0]

    assert impact(100, 10_000, 0.03) == pytest.approx(100 * (1 + 0.00025 + 0.03 * 0.1))
    assert impact(100, 10_000, 0.03, -1) == pytest.approx(100 * (1 - 0.00025 - 0.03 * 0.1))
    assert impact(9_000, 10_000, None) == pytest.approx(100 * (1 + 0.00025 + 0.02 * 0.5))  # usual sigma, at most a quarter of the volume
    assert impact(100, None, 0.03) == impact(100, 0, 0.03) == pytest.approx(100.025)
    assert one.select(backtest.per_share_commission(lit(10), lit(0))).first()[0] == 1.0
    fills = spark.createDataFrame([("a", 1000.0, 50.0, 10_000.0, 0.01), ("a", 0.0, 50.0, 1.0, 0.01), ("a", -10.0, 50.0, None, None)], "symbol string, quantity double, price double, volume double, sigma double")
    got = {k: tuple(backtest.trade_costs(fills, k).select("trades", "commission", "slippage").first()) for k in backtest.COSTS}
    assert got["frictionless"] == (2, 0.0, 0.0)
    assert got["realistic"] == (2, pytest.approx(5.0 + 1.0), pytest.approx(1010 * 50 * 5e-4))
    assert got["pessimistic"] == (2, pytest.approx(10.0 + 1.0), pytest.approx(1000 * 50 * (5e-4 + 0.01 * 0.1**0.5) + 10 * 50 * 5e-4))
    own = backtest.CostModel(commission=lambda q, n: backtest.percent_commission(n, 10.0))
    assert backtest.trade_costs(fills, own).first().commission == pytest.approx(50.5)

    t = dt.datetime(2020, 1, 1)
    preds = spark.createDataFrame([(s, t, y) for s, y in [("a", 0.3), ("b", 0.2), ("c", 0.1), ("d", -0.5), ("e", -0.05), ("f", None), ("g", float("nan")), ("h", 0.0)]], "symbol string, ts timestamp, y_pred double")
    book = lambda *how: {r.symbol: r.weight for r in backtest.long_short_targets(preds, *how).collect() if r.weight}
    assert book() == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})
    assert book(0.0, 0.0) == pytest.approx({"a": 0.2, "b": 0.2, "c": 0.2, "d": -0.2, "e": -0.2})
    assert book(0.0, 0.0, 1) == pytest.approx({"a": 0.5, "d": -0.5})
    assert set(backtest.long_short_targets(preds).toPandas().symbol) == set("abcdeh")

    targets = spark.createDataFrame([(s, t, 0.5) for s in "abc"], "symbol string, ts timestamp, weight double")
    bars = spark.createDataFrame([("a", t, 10.0, 1000.0), ("b", t, 10.0, 0.0), ("c", t, 10.0, None)], "symbol string, ts timestamp, close double, volume double")
    size = lambda **how: {r.symbol: r.quantity for r in backtest.sized_orders(targets, bars, **how).collect()}
    assert size() == {"a": 100, "b": 5000, "c": 5000}
    assert size(participation=None, lot=300) == {"a": 4800, "b": 4800, "c": 4800}
    assert size(participation=None, size=lambda w, p: w * 30) == {"a": 15, "b": 15, "c": 15}
    with pytest.raises(Exception, match="no positive price of a"):
        backtest.sized_orders(targets, bars.withColumn("close", F.when(F.col("symbol") != "a", 1.0).otherwise(0.0))).collect()


def test_numbers_without_one_task_and_intervals_without_keys(spark):
    import random

    from tidemark.operators import relational

    rng = random.Random(9)
    day = dt.timedelta(days=1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = relational.numbered(df, "x", "n", buckets=7).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.n)] == sorted(x for _, x, _ in rows) and sorted(r.n for r in got) == list(range(1, 501))
    for g in ("a", "b", None):
        own = [r for r in relational.numbered(df, "x", "n", "g", 7).collect() if r.g == g]
        assert [r.x for r in sorted(own, key=lambda r: r.n)] == sorted(x for h, x, _ in rows if h == g) and sorted(r.n for r in own) == list(range(1, len(own) + 1))
    assert relational.numbered(df.limit(0), "x", "n").count() == 0
    t0 = dt.datetime(2020, 1, 1)
    dates = [(t0 + rng.randint(0, 200) * day, k) for k in range(60)]
    members = [(f"m{k}", t0 + rng.randint(-50, 200) * day, rng.choice([None, t0 + rng.randint(0, 250) * day])) for k in range(40)]
    left, right = spark.createDataFrame(dates, "ts timestamp, k int"), spark.createDataFrame(members, "name string, valid_from timestamp, valid_to timestamp")
    met = relational.interval_join(left, right)
    assert met.columns == ["ts", "k", "name", "valid_from", "valid_to"]
    assert sorted((r.k, r.name) for r in met.collect()) == sorted((k, m) for at, k in dates for m, a, b in members if a <= at and (b is None or at < b))
    assert relational.interval_join(left.limit(0), right).count() == 0
    repeated = spark.createDataFrame([("a", t0, t0 + day, "x", 1.0), ("a", t0, t0, "x", 2.0), ("a", t0, t0, "y", None)], "symbol string, ts timestamp, available_at timestamp, name string, value double")
    assert [tuple(r)[2:] for r in relational.pivot_features(repeated, ["x", "y"]).collect()] == [(1.0, None)]
