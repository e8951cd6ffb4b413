"""Landing files, look-ahead guards, the feature registry and regressions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import causal as c
from tidemark.operators import guards, labels, regression, registry, relational
from tidemark.sources import landing


def test_price_files(spark, tmp_path):
    (tmp_path / "spy.us.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n2020-07-02,1,2,0.5,x,100\n2020-07-03,1,2,0.5,1.25,\n")
    (tmp_path / "vod.uk.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-07-02,1,2,0.5,1.5,7\n")
    got = {(r.symbol, r.ts.day, r.ts.month): r for r in landing.read_prices(spark, str(tmp_path)).withColumn("known", F.date_format("available_at", "MM-dd HH:mm")).collect()}
    assert set(got) == {("SPY.US", 2, 1), ("SPY.US", 3, 7), ("VOD.UK", 2, 7)}
    assert got["SPY.US", 2, 1].known == "01-02 21:00" and got["SPY.US", 3, 7].known == "07-03 20:00" and got["VOD.UK", 2, 7].known == "07-02 15:30"
    assert got["SPY.US", 3, 7].volume is None and got["SPY.US", 3, 7].adj_close == 1.25
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_text("Date,Open\n2020-01-01,1\n")
    with pytest.raises(landing.LandingError):
        landing.read_prices(spark, str(tmp_path / "bad"))
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.csv").write_text("Date,Open,High,Low,Close\nnever,1,1,1,1\n")
    with pytest.raises(Exception, match="unreadable date"):
        landing.read_prices(spark, str(tmp_path / "odd")).collect()


def test_series_files(spark, tmp_path):
    (tmp_path / "dgs10.csv").write_text("observation_date,DGS10\n2020-01-01,.\n2020-01-02,1.88\n")
    (tmp_path / "unrate.csv").write_text("DATE,UNRATE\n2020-01-01,3.6\n")
    got = {(r.code, r.ts.day): (r.value, r.known) for r in landing.read_series(spark, str(tmp_path)).withColumn("known", F.date_format("available_at", "yyyy-MM-dd HH:mm")).collect()}
    assert got == {("DGS10", 1): (None, "2020-01-02 13:30"), ("DGS10", 2): (1.88, "2020-01-03 13:30"), ("UNRATE", 1): (3.6, "2020-02-15 13:30")}
    close = landing.read_close_only(spark, str(tmp_path / "dgs10.csv")).collect()
    assert [(r.symbol, r.open, r.close, r.volume) for r in close] == [("DGS10", 1.88, 1.88, None)]
    with pytest.raises(ValueError):
        landing.published_at(F.lit("2020-01-01"), -1)


@pytest.fixture(scope="module")
def bars(spark):
    g = np.random.default_rng(1)
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(x)) for s in "AB" for i, x in enumerate(100 + g.normal(size=120).cumsum())]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double").withColumn("available_at", F.col("ts") + F.expr("INTERVAL 21 HOURS"))


def test_leaks_are_found(spark, bars):
    p, w = F.col("close"), c.by_symbol()
    causal = lambda d: d.select("symbol", "ts", c.pct_change(p, 3).alias("a"), c.rolling_zscore(p, 10).alias("b"), c.drawdown(p).alias("d"))
    guards.assert_causal(causal, bars)
    leaky = {
        "ahead": F.lead("close").over(w),
        "centred": F.avg("close").over(w.rowsBetween(-2, 2)),
        "whole": p - F.avg("close").over(c.W.partitionBy("symbol")),
        "filled": F.first("close", ignorenulls=True).over(w.rowsBetween(0, c.W.unboundedFollowing)),
    }
    found = guards.leakage_findings(lambda d: d.select("symbol", "ts", *(v.alias(k) for k, v in leaky.items())), bars)
    assert {r.feature for r in found.collect()} == set(leaky)
    with pytest.raises(c.LookAheadError, match="ahead"):
        guards.assert_causal(lambda d: d.select("symbol", "ts", F.lead("close").over(w).alias("ahead")), bars)


def test_order_guards(spark, bars):
    assert guards.assert_availability_ordering(bars) is bars
    with pytest.raises(c.LookAheadError):
        guards.assert_availability_ordering(bars.withColumn("available_at", F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    dealt = labels.folds(labels.forward_labels(bars.withColumn("adj_close", F.col("close")), 2), test=20, train=40, embargo_days=3)
    guards.assert_split_ordering(dealt, 2)
    with pytest.raises(c.LookAheadError):
        guards.assert_split_ordering(dealt.withColumn("role", F.when(F.col("role") == "purged", "train").otherwise(F.col("role"))).withColumn("role", F.when(F.col("role") == "embargoed", "train").otherwise(F.col("role"))), 3)


def test_registry(spark, bars, tmp_path):
    spec = registry.FeatureSpec
    one = registry.FeatureSet("demo", 1, (spec("ret_1d", ("close",), 2), spec("ret_5d", ("close",), 6, {"n": 5})))
    assert one.max_lookback == 6 and one.spec_hash() == registry.FeatureSet("demo", 1, one.features).spec_hash()
    assert one.subset(["ret_5d"]).max_lookback == 6 and one.subset(["ret_1d"]).spec_hash() != one.spec_hash()
    with pytest.raises(KeyError):
        one.subset(["unknown"])
    wide = bars.select("symbol", "ts", "available_at", c.pct_change(F.col("close")).alias("ret_1d"), c.pct_change(F.col("close"), 5).alias("ret_5d"))
    path = str(tmp_path / "features")
    assert registry.persist(one, wide, path) == 2 * (119 + 115) and registry.persist(one, wide, path) == 0
    with pytest.raises(ValueError):
        registry.persist(registry.FeatureSet("demo", 1, one.features[:1]), wide, path)
    long = registry.stored(spark, path)
    assert registry.load_values(long, "demo-v1", ["A"], ["ret_5d"]).count() == 115
    known = registry.load_matrix(long, ["ret_1d", "ret_5d"], feature_set_id="demo-v1", as_of=dt.datetime(2020, 1, 10, tzinfo=dt.timezone.utc))
    assert known.count() == 16 and known.columns == ["symbol", "ts", "ret_1d", "ret_5d"]


def test_regressions_equal_numpy(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(300, 2)) @ [[1, 0.6], [0, 1]]
    y = x @ [0.5, -0.1] + g.normal(size=300).cumsum() * 0.05
    rows = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *map(float, (*a, b))) for i, (a, b) in enumerate(zip(x, y))], "ts timestamp, a double, b double, y double")

    def robust(design, lags):
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        z = design * (y - design @ beta)[:, None]
        meat = z.T @ z
        for k in range(1, lags + 1):
            cross = z[k:].T @ z[:-k]
            meat += (1 - k / (lags + 1)) * (cross + cross.T)
        bread = np.linalg.inv(design.T @ design)
        return beta, np.sqrt(np.diag(bread @ meat @ bread) * 300 / (300 - design.shape[1]))

    lags = int(4 * 3 ** (2 / 9))
    beta, error = robust(np.column_stack([np.ones(300), x]), lags)
    got = {r.term: r for r in regression.ols_hac(rows, ["a", "b"], "y").collect()}
    np.testing.assert_allclose([got[t].coefficient for t in ("const", "a", "b")], beta, rtol=1e-8)
    np.testing.assert_allclose([got[t].std_error for t in ("const", "a", "b")], error, rtol=1e-6)
    screen = {r.feature: r for r in regression.univariate_screen(rows, ["a", "b"], "y", horizon=5).collect()}
    for k, name in enumerate("ab"):
        beta, error = robust(np.column_stack([np.ones(300), x[:, k]]), 4)
        assert screen[name].t == pytest.approx(beta[1] / error[1], rel=1e-6) and 0 <= screen[name].p <= 1
    vif = {r.feature: r.vif for r in regression.variance_inflation(rows, ["a", "b"]).collect()}
    assert vif["a"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2)) == vif["b"]


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, x double")
    assert relational.one_to_one(a, a.withColumnRenamed("x", "y"), ["k"]).count() == 2
    with pytest.raises(relational.JoinError):
        relational.one_to_one(a, a.union(a), ["k"])
    first = relational.dedup_keep_last(spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "k int, n int, v string"), ["k"], "n").first().v
    assert first == relational.dedup_keep_last(spark.createDataFrame([(1, 1, "b"), (1, 1, "a")], "k int, n int, v string"), ["k"], "n").first().v
