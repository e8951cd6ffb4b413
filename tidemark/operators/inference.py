"""Tests of series per group: autocorrelation-robust means, stationarity, Sharpe ratios."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType

#: Critical values of the level-stationarity statistic and their probabilities.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
EULER = 0.5772156649015329
#: Response surface of the unit-root statistic with a constant: its range, where the polynomials change, their terms.
UNIT_ROOT_RANGE, UNIT_ROOT_SWITCH = (-18.83, 2.74), -1.61
UNIT_ROOT_LOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def newey_west_lags(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))).cast("int")


def centred(rows: DataFrame, x: str, by: str, order: str) -> DataFrame:
    """(by, i, d, n, mean): the values that are not null, numbered in order, less their group's mean."""
    rows = rows.where(F.col(x).isNotNull())
    w = W.partitionBy(by)
    numbered = rows.select(by, F.row_number().over(w.orderBy(order)).alias("i"), F.col(x).alias("x"), F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("mean"))
    return numbered.select(by, "i", (F.col("x") - F.col("mean")).alias("d"), "n", "mean")


def autocovariances(series: DataFrame, by: str, lags: Column) -> DataFrame:
    """(by, n, mean, k, gamma) for k from 0 to lags, an expression of n; the divisor is n at every lag."""
    early = series.select(by, F.col("i"), F.col("d").alias("before"))
    late = series.select(by, "n", "mean", "d", F.explode(F.sequence(F.lit(0), lags)).alias("k"), F.col("i").alias("at")).withColumn("i", F.col("at") - F.col("k"))
    return late.join(early, [by, "i"]).groupBy(by, "n", "mean", "k").agg((F.sum(F.col("d") * F.col("before")) / F.first("n")).alias("gamma"))


def long_run(gammas: DataFrame, by: str, lags: Column) -> DataFrame:
    """(by, n, mean, lags, lrv): Bartlett-weighted long-run variance, 1e-300 at least."""
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("lags") + 1)))
    used = gammas.withColumn("lags", lags).where(F.col("k") <= F.col("lags"))
    return used.groupBy(by, "n", "mean", "lags").agg(F.greatest(F.sum(weight * F.col("gamma")), F.lit(1e-300)).alias("lrv"))


def hac_mean_test(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts") -> DataFrame:
    """n, mean, lags and t per group, with Newey-West errors and the automatic lag; groups under 10 values are left out."""
    series = centred(rows, x, by, order).where(F.col("n") >= 10)
    lags = newey_west_lags(F.col("n"))
    made = long_run(autocovariances(series, by, lags), by, lags)
    return made.select(by, "n", "mean", "lags", (F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).alias("t"))


def kpss_test(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts") -> DataFrame:
    """n, lags, statistic and p of level stationarity per group; the lag follows the data, p is cut at 0.01 and 0.10."""
    series = centred(rows, x, by, order).where(F.col("n") >= 10)
    n = F.col("n")
    wanted = F.floor(F.pow(n, F.lit(2 / 9))).cast("int")
    shape = autocovariances(series, by, wanted).groupBy(by).agg(
        F.sum(F.when(F.col("k") == 0, F.col("gamma")).otherwise(2 * F.col("gamma"))).alias("s0"), F.sum(2 * F.col("k") * F.col("gamma")).alias("s1")
    )
    # far lags are rare: the cube root grows slowly, so each group's own lag is found before its products are made
    own = F.least(F.floor(1.1447 * F.pow(F.pow(F.col("s1") / F.col("s0"), 2), F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3))).cast("int"), (n - 1).cast("int"))
    ready = series.join(shape, by).withColumn("own", own).drop("s0", "s1")
    gammas = autocovariances(ready, by, F.col("own"))
    lags = ready.select(by, F.col("own").alias("lags")).distinct()
    whole = long_run(gammas.join(lags, by), by, F.col("lags"))
    path = series.withColumn("s", F.sum("d").over(W.partitionBy(by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    eta = path.groupBy(by).agg(F.sum(F.col("s") ** 2).alias("eta"))
    statistic = F.col("eta") / (n * n * F.col("lrv"))
    p = F.lit(KPSS_P[-1])
    for (a, b), (pa, pb) in reversed(list(zip(zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]), zip(KPSS_P, KPSS_P[1:]), strict=True))):
        p = F.when(F.col("statistic") <= b, pa + (pb - pa) * (F.col("statistic") - a) / (b - a)).otherwise(p)
    p = F.when(F.col("statistic") <= KPSS_CRITICAL[0], KPSS_P[0]).otherwise(p)
    return whole.join(eta, by).withColumn("statistic", statistic).select(by, "n", "lags", "statistic", p.alias("p"))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


def _student_tail(t: float, df: float) -> float:
    """Both tails beyond |t| of the t distribution: the incomplete beta function by its continued fraction."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    tiny = 1e-300
    c, d, total = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny), 0.0
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    part = front * total / a
    return 1 - part if flip else part


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or math.isnan(a) else _student_tail(float(a), float(n)) for a, n in zip(t, df, strict=True)], dtype="float64")


def sharpe_inference(returns: DataFrame, by: str = "symbol", periods: int = 252, confidence: float = 0.95) -> DataFrame:
    """n, sharpe (a year), psr, expected_max, dsr and min_track_record_years per group; the groups are the trials.

    psr is the probability that the true ratio exceeds zero, dsr that it exceeds the largest one that as many trials
    without skill would give. Ratios of constant series are null.
    """
    got = returns.where("r is not null").groupBy(by).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    got = got.withColumn("sr", F.when(F.col("sd") >= 1e-12, F.col("mean") / F.col("sd")))
    trials = got.agg(F.count("sr").alias("trials"), F.var_samp("sr").alias("spread"))
    row = trials.first()
    many, normal = row["trials"], NormalDist()
    bound = 0.0
    if many > 1:
        bound = math.sqrt(row["spread"] or 0.0) * ((1 - EULER) * normal.inv_cdf(1 - 1 / many) + EULER * normal.inv_cdf(1 - 1 / (many * math.e)))
    sr = F.col("sr")
    shape = F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr**2, F.lit(1e-12))
    z = lambda least: (sr - least) * F.sqrt(F.col("n") - 1) / F.sqrt(shape)
    needed = F.when(sr > 0, (1 + shape * (normal.inv_cdf(confidence) / sr) ** 2) / periods)
    return got.select(
        by, "n", (sr * math.sqrt(periods)).alias("sharpe"), normal_cdf(z(0.0)).alias("psr"), F.lit(bound * math.sqrt(periods)).alias("expected_max"),
        normal_cdf(z(bound)).alias("dsr"), needed.alias("min_track_record_years"),
    )


def mean_return_test(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts") -> DataFrame:
    """hac_mean_test with p, both tails of the t distribution."""
    return hac_mean_test(rows, x, by, order).withColumn("p", student_p("t", F.col("n") - 1))


def _unit_root_p(t: float) -> float:
    if not UNIT_ROOT_RANGE[0] <= t <= UNIT_ROOT_RANGE[1]:
        return float(t > 0)
    terms = UNIT_ROOT_LOW if t <= UNIT_ROOT_SWITCH else UNIT_ROOT_HIGH
    return NormalDist().cdf(sum(c * t**k for k, c in enumerate(terms)))


def _regress(products: np.ndarray, lags: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum and inverse of the first lags + 2 columns on the last, all columns scaled to length one."""
    keep = [*range(lags + 2), len(products) - 1]
    products = products[np.ix_(keep, keep)]
    scale = np.sqrt(np.maximum(np.diag(products), 1e-300))
    products = products / np.outer(scale, scale)
    inverse = np.linalg.pinv(products[:-1, :-1], hermitian=True)
    beta = inverse @ products[:-1, -1]
    return beta, max(products[-1, -1] - beta @ products[:-1, -1], 1e-300), inverse


def _unit_root(n: int, most: int, products: np.ndarray, head: np.ndarray) -> tuple[int, float]:
    """Lags of the least AIC over the rows that all of them have, and the statistic over all rows that these lags have."""
    rows = n - 1 - most
    best = min(range(most + 1), key=lambda k: rows * math.log(_regress(products, k)[1]) + 2 * k)
    step = np.diff(head)
    early = np.array([[1.0, head[j], *step[j - best : j][::-1], step[j]] for j in range(best, most)]).reshape(-1, best + 3)
    keep = [*range(best + 2), len(products) - 1]
    beta, left, inverse = _regress(products[np.ix_(keep, keep)] + early.T @ early, best)
    free = n - 1 - best - (best + 2)
    return best, float(beta[1] / math.sqrt(left / free * inverse[1, 1]))


def adf_test(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts") -> DataFrame:
    """n, lags, statistic and p of the augmented Dickey-Fuller test with a constant per group; the AIC chooses the lags.

    Tasks add up the products of their rows' regressors; what is solved per group is a matrix of as many numbers as
    pairs of lags. Groups under 12 values are left out.
    """
    kind = rows.schema[by].dataType.simpleString()
    series = centred(rows, x, by, order).where(F.col("n") >= 12)
    most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int")
    back = F.lag("d").over(W.partitionBy(by).orderBy("i"))
    series = series.select(F.col(by).alias("key"), "i", "n", most.alias("most"), F.col("d").alias("y"), back.alias("level"))
    deepest = series.agg(F.max("most")).first()[0] or 0
    window = W.partitionBy("key").orderBy("i").rowsBetween(-deepest, 0)
    stepped = series.withColumn("steps", F.collect_list(F.col("y") - F.col("level")).over(window))

    def products(batches):
        for batch in batches:
            for (key, n, m), part in batch.groupby(["key", "n", "most"], sort=False, dropna=False):
                steps = np.stack([np.asarray(v)[-(m + 1) :][::-1] for v in part["steps"]])
                z = np.column_stack([np.ones(len(part)), part["level"], steps[:, 1:], steps[:, 0]])
                values = (z.T @ z).ravel()
                yield pd.DataFrame({"key": key, "n": n, "most": m, "place": np.arange(len(values)), "v": values})

    def solved(batches):
        for batch in batches:
            found = [_unit_root(n, m, np.reshape(np.asarray(g, float), (m + 3, m + 3)), np.asarray(h, float)) for n, m, g, h in zip(batch["n"], batch["most"], batch["products"], batch["head"], strict=True)]
            yield pd.DataFrame({by: batch["key"], "n": batch["n"], "lags": [k for k, _ in found], "statistic": [t for _, t in found], "p": [_unit_root_p(t) for _, t in found]})

    used = stepped.where("i >= most + 2").select("key", "n", "most", "level", "steps")
    parts = used.mapInPandas(products, f"key {kind}, n long, most int, place int, v double")
    whole = parts.groupBy("key", "n", "most", "place").agg(F.sum("v").alias("v")).groupBy("key", "n", "most").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("g"))
    heads = series.where("i <= most + 1").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("h"))
    ready = whole.join(heads, "key").select("key", "n", "most", F.col("g.v").alias("products"), F.col("h.y").alias("head"))
    return ready.mapInPandas(solved, f"`{by}` {kind}, n long, lags int, statistic double, p double")


def stationarity(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts", alpha: float = 0.05) -> DataFrame:
    """adf, adf_p, kpss, kpss_p and verdict per group: stationary, unit_root, inconclusive or conflicting."""
    unit = adf_test(rows, x, by, order).select(by, "n", F.col("statistic").alias("adf"), F.col("p").alias("adf_p"))
    level = kpss_test(rows, x, by, order).select(by, F.col("statistic").alias("kpss"), F.col("p").alias("kpss_p"))
    moves, drifts = F.col("adf_p") >= alpha, F.col("kpss_p") < alpha
    verdict = F.when(~moves & ~drifts, "stationary").when(moves & drifts, "unit_root").when(moves, "inconclusive").otherwise("conflicting")
    return unit.join(level, by).withColumn("verdict", verdict)


def _partials(n: int, gammas: np.ndarray) -> list[float]:
    """Partial autocorrelations by the Durbin-Levinson recursion over autocovariances with divisor n - k."""
    r = gammas * n / (n - np.arange(len(gammas)))
    found, weights, left = [1.0], np.zeros(0), r[0]
    for k in range(1, len(r)):
        share = (r[k] - weights @ r[1:k][::-1]) / left if left > 0 else math.nan
        weights = np.append(weights - share * weights[::-1], share)
        left *= 1 - share**2
        found.append(float(share))
    return found


@F.pandas_udf(ArrayType(DoubleType()))
def _partials_of(n: pd.Series, gammas: pd.Series) -> pd.Series:
    return pd.Series([_partials(int(a), np.asarray(g, float)) for a, g in zip(n, gammas, strict=True)])


def partial_autocorrelation(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts", lags: int = 20) -> DataFrame:
    """by, n, lag, acf, pacf and the 95 % band of white noise, for lags from 0; groups of lags + 1 values or fewer are left out."""
    series = centred(rows, x, by, order).where(F.col("n") > lags + 1)
    gammas = autocovariances(series, by, F.lit(lags)).groupBy(by, "n").agg(F.sort_array(F.collect_list(F.struct("k", "gamma"))).getField("gamma").alias("g"))
    g = F.slice("g", 1, F.least(F.lit(lags), F.floor(F.col("n") / 2).cast("int") - 1) + 1)
    both = gammas.select(by, "n", g.alias("g")).select(by, "n", F.arrays_zip("g", _partials_of("n", "g").alias("pacf")).alias("z"), F.col("g")[0].alias("g0"))
    long = both.select(by, "n", "g0", F.posexplode("z").alias("lag", "z"))
    return long.select(by, "n", "lag", F.try_divide(F.col("z.g"), F.col("g0")).alias("acf"), F.nanvl(F.col("z.pacf"), F.lit(None).cast("double")).alias("pacf"), (1.96 / F.sqrt("n")).alias("band"))
