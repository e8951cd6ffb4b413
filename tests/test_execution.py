"""Execution of orders, books, lookups and comparisons against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import backtest, evaluation, execution, labels, learners, models, relational, risk

DAY = dt.datetime(2021, 3, 1)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def made_bars(rng, symbols="abc", days=60):
    rows = []
    for s in symbols:
        for i in sorted(rng.sample(range(days), days * 2 // 3)):
            price, spread = rng.uniform(50, 150), rng.uniform(0, 10)
            opened = rng.choice([price, price, price, 0.0, float("nan")])
            rows.append((s, DAY + dt.timedelta(days=i), opened, price + spread, price - spread, price + 0.3 * spread, rng.choice([100.0, 1000.0, None, 0.0, float("nan")])))
    return rows


def test_executed_equals_a_loop(spark):
    rng = random.Random(1)
    bars = made_bars(rng)
    orders = []
    for i in range(300):
        at = DAY + dt.timedelta(hours=rng.randrange(-100, 24 * 62))
        at = rng.choice([at, at.replace(hour=0)])  # some at the instant of a bar
        orders.append((i, rng.choice("abcd"), at, rng.choice([-400.0, -20.0, 5.0, 300.0]), rng.choice([None, rng.uniform(50, 150)]), rng.choice([None, 0.05])))
    made = spark.createDataFrame(orders, "id int, symbol string, decision_ts timestamp, quantity double, limit_price double, sigma double")
    costs = backtest.COSTS["pessimistic"]
    got = {r.id: r for r in execution.executed(made, spark.createDataFrame(bars, BARS), costs=costs).collect()}
    assert len(got) == 300
    for i, symbol, at, q, limit, sigma in orders:
        later = sorted((b for b in bars if b[0] == symbol and b[1] > at), key=lambda b: b[1])
        row, reason = got[i], "filled"
        price = later[0][2] if later else None
        volume = later[0][6] if later else None
        known = volume is not None and not math.isnan(volume) and volume > 0
        if not later:
            reason = "no_later_bar"
        elif not price > 0:
            reason = "non_positive_reference_price"
        elif known and abs(q) > 0.25 * volume:
            reason = "exceeds_max_participation"
        elif limit is not None and not (later[0][4] <= limit if q > 0 else later[0][3] >= limit):
            reason = "limit_not_reached"
        assert row.status == reason and row.execution_ts == (later[0][1] if later else None)
        if reason != "filled":
            assert row.fill_price is row.commission is row.slippage is row.reference is None
            continue
        reference = price if limit is None else (min if q > 0 else max)(price, limit)
        impact = (sigma or 0.02) * math.sqrt(min(abs(q) / volume, 0.25)) if known else 0.0
        fill = reference * (1 + math.copysign(5 / 10_000 + impact, q))
        assert (row.reference, row.fill_price) == pytest.approx((reference, fill))
        assert row.commission == pytest.approx(min(max(0.01 * abs(q), 1.0), 0.01 * abs(q) * fill)) and row.slippage == pytest.approx(abs(q) * abs(fill - reference))
    assert {r.status for r in got.values()} == {"filled", *execution.REJECTIONS}
    at_close = execution.executed(made.drop("limit_price", "sigma"), spark.createDataFrame(bars, BARS), at="close", participation=None)
    assert at_close.columns == ["id", "symbol", "decision_ts", "quantity", "execution_ts", "status", "reference", "fill_price", "commission", "slippage"]
    assert {r.status for r in at_close.select("status").distinct().collect()} == {"filled", "no_later_bar"}
    assert execution.executed(made.limit(0), spark.createDataFrame(bars, BARS)).count() == 0
    assert {r.status for r in execution.executed(made, spark.createDataFrame([], BARS)).collect()} == {"no_later_bar"}
    with pytest.raises(ValueError):
        execution.executed(made, spark.createDataFrame(bars, BARS), at="decision")


def test_book_equals_a_loop(spark):
    rng = random.Random(2)
    bars = made_bars(rng)
    targets = [(b[0], b[1], rng.choice([-0.4, 0.0, 0.2, 0.3])) for b in bars if rng.random() < 0.5]
    costs = backtest.COSTS["realistic"]
    made = execution.book(spark.createDataFrame(targets, "symbol string, ts timestamp, weight double"), spark.createDataFrame(bars, BARS), 10_000.0, costs=costs)
    cash, position, last, fills, curve = 10_000.0, dict.fromkeys("abc", 0.0), {}, [], []
    wanted, goal = {(s, t): w for s, t, w in targets}, {}
    for at in sorted({b[1] for b in bars}):
        today = [b for b in bars if b[1] == at]
        for s, _, opened, *_ in today:
            if s in goal:
                q = goal.pop(s) - position[s]
                if opened > 0 and q:
                    price = opened * (1 + math.copysign(5 / 10_000, q))
                    cash -= q * price + min(max(0.005 * abs(q), 1.0), 0.01 * abs(q) * price)
                    position[s] += q
                    fills.append((s, at, q))
        for b in today:
            last[b[0]] = b[5]
            if (b[0], at) in wanted:
                goal[b[0]] = math.trunc(wanted[b[0], at] * 10_000 / b[5])
        curve.append((at, cash + sum(position[s] * last.get(s, 0.0) for s in "abc")))
    assert sorted((r.symbol, r.execution_ts, r.quantity) for r in made["fills"].collect()) == sorted(fills)
    got = sorted((r.ts, r.equity) for r in made["equity"].collect())
    assert [t for t, _ in got] == [t for t, _ in curve]
    np.testing.assert_allclose([e for _, e in got], [e for _, e in curve])


def test_lookup_takes_the_last_known_entry_once(spark):
    hour = dt.timedelta(hours=1)
    entries = [("a", DAY, DAY, 1.0), ("a", DAY, DAY + 2 * hour, 2.0), ("a", DAY, DAY + 2 * hour, 2.0), ("a", DAY, None, 9.0), ("b", DAY, DAY + hour, 3.0), (None, DAY, DAY, 4.0)]
    book = spark.createDataFrame(entries, "symbol string, ts timestamp, available_at timestamp, y_pred double")
    asked = spark.createDataFrame([("a", DAY, DAY + hour), ("a", DAY, DAY + 3 * hour), ("b", DAY, DAY), ("c", DAY, DAY), (None, DAY, DAY)], "symbol string, ts timestamp, as_of timestamp")
    got = relational.lookup(asked, book, "y_pred", ["symbol", "ts"]).collect()
    assert sorted((r.symbol or "", r.as_of, r.y_pred) for r in got) == [("", DAY, None), ("a", DAY + hour, 1.0), ("a", DAY + 3 * hour, 2.0), ("b", DAY, None), ("c", DAY, None)]


def test_paired_forecasts_need_one_target(spark):
    rows = [("m", "a", DAY, 1.0, 0.5), ("z", "a", DAY, 1.0, 0.0), ("m", "b", DAY, 2.0, 0.5)]
    schema = "model string, symbol string, ts timestamp, y_true double, y_pred double"
    assert [tuple(r) for r in evaluation.paired_forecasts(spark.createDataFrame(rows, schema), "m", "z").collect()] == [("a", DAY, 1.0, 0.5, 0.0)]
    with pytest.raises(PySparkException, match="targets differ for b"):
        evaluation.paired_forecasts(spark.createDataFrame([*rows, ("z", "b", DAY, 2.1, 0.0)], schema), "m", "z").collect()


def test_compare_goes_on_when_a_model_fails(spark):
    g = np.random.default_rng(5)
    rows = [(0, "train" if i < 150 else "test", "s", DAY + dt.timedelta(days=i), float(x), float(x > 0)) for i, x in enumerate(g.normal(size=200))]
    dealt = spark.createDataFrame(rows, "fold int, role string, symbol string, ts timestamp, x double, label double")

    def refused(n, **params):
        raise ValueError("no such thing")

    ladder = [learners.get("logistic"), learners.Learner("broken", "regression", refused), learners.get("logistic", C=0.1), learners.Learner("hungry", "regression", refused, least=10_000)]
    metrics, forecasts, failed = learners.compare(dealt, ["x"], ladder)
    assert {r.model: r.n for r in metrics.collect()} == {"logistic": 50, "logistic_2": 50} and forecasts.count() == 100
    assert failed == {"broken": "no such thing", "hungry": "no fold has enough training rows"}
    metrics, forecasts, failed = learners.compare(dealt, ["x"], [])
    assert metrics.count() == forecasts.count() == 0 and failed == {}


def test_fits_of_many_groups(spark):
    """As many fits as groups, a null one and one of too few rows among them, without a collection on the driver."""
    g = np.random.default_rng(6)
    x = g.normal(size=(300, 40))
    rows = [(None if k == 0 else f"g{k}", float(v), float(k * v + 0.1)) for k in range(300) for v in x[k, : 40 if k != 7 else 10]]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fitted = models.fit(df, ["x"], "y", "g", models.ridge, alpha=1e-9)
    got = {r.g: r for r in fitted.collect()}
    assert len(got) == 299 and "g7" not in got
    for k in (0, 1, 250):
        row = got[None if k == 0 else f"g{k}"]
        assert row.coefficients[0] == pytest.approx(k, abs=1e-6) and row.intercept == pytest.approx(0.1, abs=1e-6)
    predicted = models.predict(df.where("g = 'g250'"), fitted, ["x"], "g")
    assert predicted.count() == 40 and predicted.where("abs(y_pred - y) > 1e-6").count() == 0


def test_risk_and_labels_by_method(spark):
    g = np.random.default_rng(8)
    price = 100 * np.exp(np.cumsum(g.normal(0, 0.02, 80)))
    price[40] = np.nan
    rows = [("s", DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i), None if math.isnan(v) else float(v)) for i, v in enumerate(price)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, available_at timestamp, adj_close double")
    r = np.diff(np.log(price), prepend=np.nan)
    for inclusive in (True, False):
        got = [x.sigma for x in risk.trailing_volatility(bars, 30, inclusive=inclusive, periods=252).orderBy("ts").collect()]
        for i, sigma in enumerate(got):
            end = i + 1 if inclusive else i
            window = r[max(0, end - 30) : end]
            window = window[np.isfinite(window)]
            assert sigma is None if len(window) < 20 else sigma == pytest.approx(window.std(ddof=1) * math.sqrt(252))
    values = {(x.direction, x.ts): x.value for x in labels.stored_returns(bars, (1,), method="log").collect()}
    assert values["trailing", DAY + dt.timedelta(days=5)] == pytest.approx(r[5]) and values["forward", DAY + dt.timedelta(days=5)] == pytest.approx(r[6])
    with pytest.raises(ValueError):
        labels.stored_returns(bars, method="compound")
    with pytest.raises(ValueError):
        risk.rolling_var(bars["adj_close"], method="guess")


def test_training_frame_is_one_to_one(spark):
    features = spark.createDataFrame([("a", DAY, DAY, 1.0), ("b", DAY, DAY, None)], "symbol string, ts timestamp, available_at timestamp, x double")
    known = spark.createDataFrame([("a", DAY, DAY, 0.5), ("b", DAY, DAY, 0.5)], "symbol string, ts timestamp, label_available_at timestamp, label double")
    assert [r.symbol for r in labels.training_frame(features, known, ["x"]).collect()] == ["a"]
    with pytest.raises(relational.JoinError):
        labels.training_frame(features.unionByName(features), known, ["x"])
