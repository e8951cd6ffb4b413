"""Stationarity, resampling, learners, runs, jobs and studies against plain numpy."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import bootstrap, inference, learners, portfolio, quality, registry, relational, runs, study

DAY = dt.datetime(2020, 1, 1)


def series(spark, **columns):
    rows = [(s, DAY + dt.timedelta(days=i), float(x)) for s, values in columns.items() for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, r double")


def unit_root(y):
    """The test as it is defined, by least squares over whole design matrices."""
    n, d = len(y), np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def design(lags, first):
        z = np.array([[1.0, y[t], *(d[t - k] for k in range(1, lags + 1))] for t in range(first, n - 1)])
        return z, d[first:]

    def aic(lags):
        z, v = design(lags, most)
        left = v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        return len(v) * math.log(left @ left / len(v)) + 2 * lags

    best = min(range(most + 1), key=aic)
    z, v = design(best, best)
    beta = np.linalg.lstsq(z, v, rcond=None)[0]
    left = v - z @ beta
    return best, beta[1] / math.sqrt(left @ left / (len(v) - best - 2) * np.linalg.inv(z.T @ z)[1, 1])


def test_unit_roots(spark):
    g = np.random.default_rng(1)
    noise, walk = g.normal(size=300), g.normal(size=250).cumsum() + 1e4
    lagged = np.zeros(200)
    for t in range(2, 200):
        lagged[t] = 0.5 * lagged[t - 1] - 0.3 * lagged[t - 2] + g.normal()
    df = series(spark, noise=noise, walk=walk, lagged=lagged, short=[1.0] * 5)
    got = {r.symbol: r for r in inference.adf_test(df).collect()}
    assert set(got) == {"noise", "walk", "lagged"}
    for name, y in (("noise", noise), ("walk", walk), ("lagged", lagged)):
        lags, t = unit_root(y)
        assert got[name].lags == lags and got[name].statistic == pytest.approx(t, rel=1e-6)
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert inference._unit_root_p(t) == pytest.approx(p, abs=2e-3)
    assert inference._unit_root_p(-30) == 0 and inference._unit_root_p(3) == 1
    for r in inference.mean_return_test(df).collect():
        assert r.p == pytest.approx(inference._student_tail(r.t, r.n - 1))
    verdicts = {r.symbol: r.verdict for r in inference.stationarity(df).collect()}
    assert verdicts["noise"] == "stationary" and verdicts["walk"] == "unit_root"
    assert inference.adf_test(df.limit(0)).count() == 0


def test_partial_autocorrelation(spark):
    g = np.random.default_rng(2)
    y = np.convolve(g.normal(size=130), [1, 0.6, -0.2])[:120]
    got = sorted(inference.partial_autocorrelation(series(spark, a=y, b=y[:6]), lags=6).collect(), key=lambda r: r.lag)
    e = y - y.mean()
    gamma = np.array([e[k:] @ e[: len(e) - k] for k in range(7)])
    r = gamma / (120 - np.arange(7))
    for k, row in enumerate(got):
        want = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1 : k + 1])[-1] if k else 1.0
        assert row.lag == k and row.pacf == pytest.approx(want) and row.acf == pytest.approx(gamma[k] / gamma[0])
    assert len(got) == 7 and got[0].band == pytest.approx(1.96 / math.sqrt(120))


def test_bootstrap_equals_index_draws(spark):
    g = np.random.default_rng(3)
    x, y = g.normal(0.05, 1, 60), g.normal(0, 1, 35)
    df = series(spark, a=x, b=y, short=x[:20])

    def share(kind, draw, i):
        return int(hashlib.md5(f"{kind}:9:{draw}:{i}".encode()).hexdigest()[:8], 16) / 2**32

    def draws(values):
        for draw in range(40):
            at, chosen = 0, []
            for i in range(len(values)):
                at = int(share("start", draw, i) * len(values)) if i == 0 or share("cut", draw, i) < 0.2 else (at + 1) % len(values)
                chosen.append(values[at])
            yield np.array(chosen)

    for statistic, f in (("mean", np.mean), ("sharpe", lambda v: v.mean() / v.std(ddof=1) * math.sqrt(252))):
        got = {r.symbol: r for r in bootstrap.stationary_bootstrap(df, statistic=statistic, draws=40, mean_block=5, seed=9).collect()}
        assert set(got) == {"a", "b"}
        for name, values in (("a", x), ("b", y)):
            want = np.array([f(v) for v in draws(values)])
            row = got[name]
            assert (row.point, row.lower, row.upper, row.spread, row.share_above_zero) == pytest.approx((f(values), *np.quantile(want, [0.025, 0.975]), want.std(ddof=1), (want > 0).mean()))
    with pytest.raises(ValueError):
        bootstrap.stationary_bootstrap(df, statistic="median")


def test_frontier():
    g = np.random.default_rng(4)
    a = g.normal(size=(4, 4))
    cov, mean = a @ a.T + 0.2 * np.eye(4), np.array([0.01, 0.03, 0.02, 0.08])
    random = g.dirichlet(np.ones(4) * 0.7, 20000)
    for target, sd, w in portfolio.efficient_frontier(cov, mean, 9):
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and w @ mean == pytest.approx(target, abs=1e-7) and sd == pytest.approx(math.sqrt(w @ cov @ w))
        near = random[np.abs(random @ mean - target) < 2e-4]
        if len(near):
            assert sd <= np.sqrt(np.einsum("ij,jk,ik->i", near, cov, near)).min() * 1.01


def test_learners(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(400, 2)) * [1, 10]
    y = (x[:, 0] + 0.3 * g.normal(size=400) > 0).astype(float)
    roles = ["train"] * 300 + ["test"] * 80 + ["purged"] * 20
    rows = [(0, role, "s", DAY + dt.timedelta(days=i), *map(float, v), float(z)) for i, (role, v, z) in enumerate(zip(roles, x, y))]
    rows += [(1, "train", "s", DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0) for i in range(150)] + [(0, "test", "s", DAY, None, 1.0, 1.0)]
    dealt = spark.createDataFrame(rows, "fold int, role string, symbol string, ts timestamp, a double, b double, label double")
    ladder = [learners.get("logistic"), learners.get("random_forest_clf", trees=10), learners.get("gradient_boosting_clf", iterations=5)]
    preds, weights = learners.walk_forward(dealt, ["a", "b"], ladder)
    got = preds.toPandas()
    assert set(got["fold"]) == {0} and len(got) == 240
    assert (((got["y_pred"] >= 0.5) == (got["y_true"] == 1)).groupby(got["model"]).mean() > 0.85).all()
    # the penalised loss by Newton steps, features scaled by their sample deviation
    z = np.column_stack([np.ones(300), x[:300] / x[:300].std(0, ddof=1)])
    w, hold = np.zeros(3), np.diag([0, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + hold, z.T @ (p - y[:300]) + hold @ w)
    found = {r.feature: r.importance for r in weights.where("model = 'logistic'").collect()}
    assert [found["a"], found["b"]] == pytest.approx(list(w[1:] / x[:300].std(0, ddof=1)), rel=1e-3, abs=1e-4)
    mean = {(r.model, r.feature): r.importance for r in learners.mean_importance(weights).collect()}
    assert mean["random_forest_clf", "a"] > mean["random_forest_clf", "b"]
    forecast, _ = learners.walk_forward(dealt.where("fold = 0"), ["a", "b"], [learners.get("random_forest", trees=5), learners.get("gradient_boosting", iterations=3)])
    assert forecast.groupBy("model").count().count() == 2
    with pytest.raises(KeyError):
        learners.get("oracle")
    with pytest.raises(ValueError):
        learners.register(learners.Learner("logistic", "classification", None))


def test_runs(spark, tmp_path):
    rows = [(1, "a", 1.5), (2, None, 2.5), (3, "", None)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    one = runs.fingerprint(df).first()
    assert one == runs.fingerprint(spark.createDataFrame(rows[::-1], df.schema).select("x", "s", "i")).first()
    for other in ([*rows, rows[0]], rows[:2], [(1, "a", 1.5), (2, "", 2.5), (3, "", None)]):
        assert one != runs.fingerprint(spark.createDataFrame(other, df.schema)).first()
    assert runs.fingerprint(df.limit(0)).first().n == 0
    config = {"b": 1, "a": [1, 2]}
    run = runs.run_id(config, df)
    assert run == runs.run_id({"a": [1, 2], "b": 1}, df) and run != runs.run_id(config, df, seed=1)
    path = str(tmp_path / "runs")
    assert runs.persist({"predictions": df}, path, run, config, {"sharpe": 1.25, "sortino": math.inf, "n": None})
    assert not runs.persist({"predictions": df.limit(0)}, path, run, config)
    assert runs.load(spark, path, "predictions", run).count() == 3
    assert runs.persist({"predictions": df.limit(1)}, path, run, config, replace=True)
    assert runs.load(spark, path, "predictions", run).count() == 1
    assert runs.persist({"predictions": df}, path, "second", config, {"sharpe": 0.5})
    shown = {r.run: r.sharpe for r in runs.manifests(spark, path).select("run", runs.metric("metrics", "sharpe").alias("sharpe")).collect()}
    assert shown == {run: None, "second": 0.5}
    slugs = spark.createDataFrame([(" a/b c.US ",), ("__",)], "s string").select(runs.slug(F.col("s")).alias("s"))
    assert [r.s for r in slugs.collect()] == ["a_b_c.US", "unknown"]


def test_ingestion(spark, tmp_path):
    files, path = tmp_path / "in", str(tmp_path / "bars")
    files.mkdir()
    head = "Date,Open,High,Low,Close,Volume\n"
    line = lambda day, close, high=9: f"{day},2,{high},1,{close},10\n"
    (files / "a.us.csv").write_text(head + line("2020-01-02", 2) + line("2020-01-30", 3) + line("2020-02-03", 4))
    (files / "b.us.csv").write_text(head + line("2020-01-02", 5, high=1))
    got = {r.symbol: r for r in jobs.ingest_prices(spark, str(files), path).collect()}
    assert (got["A.US"].status, got["A.US"].n_loaded) == ("loaded", 3)
    assert (got["B.US"].status, got["B.US"].n_loaded, got["B.US"].failed) == ("failed", 0, ["ohlc_consistency"])
    (files / "a.us.csv").write_text(head + line("2020-01-02", 8) + line("2020-01-30", 7) + line("2020-02-03", 4) + line("2020-03-02", 6))
    got = {r.symbol: r for r in jobs.ingest_prices(spark, str(files), path).collect()}
    assert got["A.US"].n_loaded == 3
    # the old row lies before the overlap and stays, the revised one within it changes
    stored = spark.read.parquet(path).where("symbol = 'A.US'").orderBy("ts")
    assert [r.close for r in stored.collect()] == [2.0, 7.0, 4.0, 6.0]
    codes = tmp_path / "series"
    codes.mkdir()
    (codes / "dgs10.csv").write_text("DATE,DGS10\n2020-01-02,1.5\n2020-01-03,1.6\n")
    assert [r.status for r in jobs.ingest_series(spark, str(codes), str(tmp_path / "macro")).collect()] == ["loaded"]


def test_feature_and_training_jobs(spark, tmp_path):
    g = np.random.default_rng(6)
    rows = [(s, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i, hours=21), *[float(p)] * 5, 100.0) for s in "AB" for i, p in enumerate(np.exp(g.normal(0, 0.02, 160).cumsum()))]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, available_at timestamp, open double, high double, low double, close double, adj_close double, volume double")
    assert jobs.materialise_returns(bars, str(tmp_path / "returns"), (1, 5)) == 2 * 2 * (159 + 155)
    wanted = registry.FeatureSet("few", 1, (registry.FeatureSpec("ret_1d"), registry.FeatureSpec("ret_5d")))
    assert jobs.generate_features(bars, str(tmp_path / "features"), wanted) == 2 * (159 + 155)
    assert jobs.generate_features(bars, str(tmp_path / "features"), wanted) == 0
    run = jobs.train(bars, str(tmp_path / "runs"), ["ret_1d", "ret_5d"], 1, 2, 20, 60)
    assert run == jobs.train(bars, str(tmp_path / "runs"), ["ret_1d", "ret_5d"], 1, 2, 20, 60)
    assert runs.load(spark, str(tmp_path / "runs"), "predictions", run).groupBy("model", "fold").count().count() == 10


def test_universe_and_validation(spark):
    bars = series(spark, A=[1, 2], B=[1])
    members = spark.createDataFrame([("A", DAY, DAY + dt.timedelta(days=5)), ("B", DAY + dt.timedelta(days=3), None)], "symbol string, valid_from timestamp, valid_to timestamp")
    names = lambda **how: ({r.symbol for r in relational.resolve_universe(bars, **how)[0].collect()}, relational.resolve_universe(bars, **how)[1])
    assert names(symbols=[" x ", "y"]) == ({"X", "Y"}, "explicit")
    assert names(members=members, at="2020-01-02") == ({"A"}, "point_in_time") and names(members=members, at="2020-01-06") == ({"B"}, "point_in_time")
    assert names() == ({"A", "B"}, "survivors")
    with pytest.raises(relational.UniverseError):
        relational.resolve_universe(bars, members=members, at="2019-01-01")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    got = {r.symbol: r.status for r in quality.validate_stored(bars, wanted, F.lit(dt.date(2020, 1, 9))).collect()}
    assert got == {"A": "PASS", "B": "WARN", "C": "FAIL"}


def test_verdicts(spark):
    g = np.random.default_rng(7)
    y = g.normal(0, 0.01, (200, 2))
    at = [(s, DAY + dt.timedelta(days=i), float(y[i, k])) for k, s in enumerate("AB") for i in range(200)]

    def verdict(**models):
        rows = [(m, s, ts, float(f(v)), v) for m, f in {"zero": lambda v: 0.0, **models}.items() for s, ts, v in at]
        return study.verdict(spark.createDataFrame(rows, "model string, symbol string, ts timestamp, y_pred double, y_true double")).first()

    assert verdict().verdict == "unanswered"
    assert verdict(bad=lambda v: -v).verdict == "no_improvement"
    good = verdict(good=lambda v: 0.5 * v, bad=lambda v: -v)
    assert (good.models, good.positive_r2, good.significant, good.economic, good.verdict) == (2, 1, 1, 1, "provisional_yes")
    hedged = verdict(hedged=lambda v: 0.9 * v if v > 0.015 else -1e-6)
    assert hedged.significant == 1 and hedged.verdict in ("economically_irrelevant", "provisional_yes")
