"""Portfolio weights from a shrunk covariance. Spark aggregates the moments; the N x N problem (50 assets at most) is solved on the driver."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ASSETS = 50


def shrunk_covariance(returns: DataFrame, symbols: list[str], shrinkage: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean returns, covariance, shrinkage) over the instants at which all symbols have a return.

    Without a given shrinkage the optimal intensity towards a scaled identity is used; a given one shrinks towards the
    diagonal.
    """
    if len(symbols) > MOST_ASSETS:
        raise ValueError(f"at most {MOST_ASSETS} assets")
    wide = returns.groupBy("ts").pivot("symbol", symbols).agg(F.first("r")).toDF("ts", *(f"x{i}" for i in range(len(symbols)))).drop("ts").dropna()
    p = len(symbols)
    pairs = list(combinations_with_replacement(range(p), 2))
    first = wide.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    n = first["n"]
    if n < 2:
        raise ValueError("fewer than two common instants")
    mean = np.array([first[f"m{i}"] for i in range(p)])
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = first[f"c{i}_{j}"]
    if shrinkage is not None:
        sample = cov * n / (n - 1)
        return mean, (1 - shrinkage) * sample + shrinkage * np.diag(np.diag(sample)), shrinkage
    squares = sum(((F.col(f"x{i}") - float(mean[i])) ** 2 for i in range(p)), F.lit(0.0))
    fourth = wide.agg(F.avg(squares**2)).first()[0]
    mu, total = np.trace(cov) / p, (cov**2).sum()
    distance = (total - p * mu**2) / p
    noise = min((fourth - total) / (n * p), distance)
    intensity = float(noise / distance) if distance > 0 else 0.0
    return mean, (1 - intensity) * cov + intensity * mu * np.eye(p), intensity


def _nonnegative(cov: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The u >= 0 with the least u'Cu/2 - gain'u: assets enter while they would help, and leave when they turn negative."""
    u, held = np.zeros(len(gain)), np.zeros(len(gain), bool)
    for _ in range(20 * len(gain)):
        slope = np.where(held, -np.inf, gain - cov @ u)
        if slope.max() <= 1e-10 * np.abs(gain).max():
            break
        held[slope.argmax()] = True
        while held.any():
            aim = np.zeros(len(gain))
            aim[held] = np.linalg.solve(cov[np.ix_(held, held)], gain[held])
            down = held & (aim <= 0)
            if not down.any():
                u = aim
                break
            step = (u[down] / np.maximum(u[down] - aim[down], 1e-300)).min()
            u = np.where(held, u + step * (aim - u), 0.0)
            held &= u > 1e-15
    return u


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    """Long-only weights of the least variance."""
    u = _nonnegative(cov, np.ones(len(cov)))
    return u / u.sum()


def maximum_sharpe(cov: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """Long-only weights of the largest Sharpe ratio; minimum variance where no asset has an excess return."""
    if excess.max() <= 0:
        return minimum_variance(cov)
    u = _nonnegative(cov, excess)
    return u / u.sum()


def risk_parity(cov: np.ndarray, rounds: int = 1000, tolerance: float = 1e-12) -> np.ndarray:
    """Positive weights whose risk contributions are equal."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        before = w.copy()
        for i in range(n):
            other = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-other + np.sqrt(other**2 + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - before).max() <= tolerance * np.abs(w).max():
            break
    return w / w.sum()


def risk_contributions(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Shares of the variance that add up to one."""
    parts = w * (cov @ w)
    return parts / parts.sum()


def weights(returns: DataFrame, symbols: list[str], shrinkage: float | None = None) -> DataFrame:
    """method, symbol, weight, risk_contribution, diversification per long-only method."""
    mean, cov, _ = shrunk_covariance(returns, symbols, shrinkage)
    sd = np.sqrt(np.diag(cov))
    made = {
        "equal_weight": np.full(len(sd), 1 / len(sd)),
        "inverse_volatility": (1 / sd) / (1 / sd).sum(),
        "minimum_variance": minimum_variance(cov),
        "maximum_sharpe": maximum_sharpe(cov, mean),
        "risk_parity": risk_parity(cov),
    }
    rows = [
        (method, s, float(x), float(part), float(w @ sd / np.sqrt(w @ cov @ w)))
        for method, w in made.items()
        for s, x, part in zip(symbols, w, risk_contributions(w, cov), strict=True)
    ]
    return returns.sparkSession.createDataFrame(rows, "method string, symbol string, weight double, risk_contribution double, diversification double")


def _least_variance_at(cov: np.ndarray, mean: np.ndarray, target: float) -> np.ndarray:
    """Long-only weights of the least variance that return `target`, which is not below that of minimum_variance.

    The portfolio of the largest Sharpe ratio over a riskless rate moves along the frontier as that rate rises to the
    largest mean, so the rate is found by bisection.
    """
    best, span = mean.max(), max(np.ptp(mean), 1e-300)

    def at(log_distance: float) -> np.ndarray:
        u = _nonnegative(cov, mean - best + span * 10.0**log_distance)
        return u / u.sum()

    near, far = -9.0, 9.0
    for _ in range(80):
        middle = (near + far) / 2
        near, far = (middle, far) if at(middle) @ mean > target else (near, middle)
    return at((near + far) / 2)


def efficient_frontier(cov: np.ndarray, mean: np.ndarray, points: int = 25) -> list[tuple[float, float, np.ndarray]]:
    """(target return, volatility, weights) for evenly spaced returns between the least and the largest mean; long only."""
    turn = minimum_variance(cov) @ mean
    found = []
    for target in np.linspace(mean.min(), mean.max(), points):
        if target in (mean.min(), mean.max()):
            w = np.eye(len(mean))[mean.argmin() if target == mean.min() else mean.argmax()]
        else:
            w = _least_variance_at(cov, mean, target) if target >= turn else _least_variance_at(cov, -mean, -target)
        found.append((float(target), float(np.sqrt(w @ cov @ w)), w))
    return found


def frontier(returns: DataFrame, symbols: list[str], points: int = 25, shrinkage: float | None = None) -> DataFrame:
    """point, target_return, volatility, symbol, weight of the long-only frontier."""
    mean, cov, _ = shrunk_covariance(returns, symbols, shrinkage)
    rows = [(k, t, sd, s, float(x)) for k, (t, sd, w) in enumerate(efficient_frontier(cov, mean, points)) for s, x in zip(symbols, w, strict=True)]
    return returns.sparkSession.createDataFrame(rows, "point int, target_return double, volatility double, symbol string, weight double")
