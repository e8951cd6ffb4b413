"""Any statistic of a series as an aggregate: over groups, over trailing rows, and under the stationary bootstrap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.causal import trailing

Statistic = Callable[[np.ndarray], float]
LEAST = 30
#: Draws of one bootstrap task.
TASK_DRAWS = 250


def max_drawdown(returns: np.ndarray) -> float:
    """Deepest fall of the compounded curve below its highest value so far, its start included; at most 0."""
    curve = np.concatenate([[1.0], np.cumprod(1 + returns)])
    return float((curve / np.maximum.accumulate(curve) - 1).min())


def statistic(fn: Statistic, least: int = 1) -> Callable[[Column, Column], Column]:
    """An aggregate (x, order) -> fn of the finite values of x, in that order; null for fewer than `least` of them.

    It serves groupBy().agg() and bounded row windows alike. fn gets a whole group, so a group has to fit one worker; what
    it returns may be NaN or infinite, which becomes null.
    """

    @F.pandas_udf("double")
    def run(x: pd.Series, order: pd.Series) -> float:
        at = np.argsort(order.to_numpy(), kind="stable")
        values = x.to_numpy(np.float64, na_value=np.nan)[at]
        values = values[np.isfinite(values)]
        if len(values) < max(1, least):
            return None
        found = float(fn(values))
        return found if np.isfinite(found) else None

    return lambda x, order: run(x.cast("double"), order)


def rolling_statistic(df: DataFrame, fn: Statistic, column: str, n: int, name: str, order: str = "ts") -> DataFrame:
    """df with fn over the last n rows of each symbol; null where one of them has no value."""
    return df.withColumn(name, statistic(fn, n)(F.col(column), F.col(order)).over(trailing(n)))


def bootstrap_places(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Places of one draw: blocks of geometric length with the given mean, which begin anywhere and go round at the end."""
    if n < 1 or not mean_block >= 1:
        raise ValueError("a bootstrap needs values and blocks of at least one")
    fresh = rng.random(n) < 1 / mean_block
    fresh[0] = True
    first = np.flatnonzero(fresh)
    starts = rng.integers(0, n, len(first))
    block = np.cumsum(fresh) - 1
    return (starts[block] + np.arange(n) - first[block]) % n


def bootstrap_statistic(rows: DataFrame, fn: Statistic, x: str = "r", by: str = "symbol", order: str = "ts", draws: int = 1000, mean_block: float = 20.0, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """by, n, point, lower, upper, spread, share_above_zero, drawn: stationary bootstrap of any statistic of each group's series.

    Draw k of a group has a generator of its own, seeded by (seed, k), so it does not matter which task makes it. A group's
    draws are dealt to tasks of 250, each with the group's series. Values that are not finite are left out, as are groups of
    fewer than 30 values and draws whose statistic is not finite (`drawn` counts the others).
    """
    value = F.col(x).cast("double")
    seen = rows.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(F.col(by).alias("by"), F.col(order).alias("at"), value.alias("x"))
    each = TASK_DRAWS
    dealt = seen.withColumn("deal", F.explode(F.array(*(F.lit(k) for k in range(-(-draws // each))))))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("at", kind="stable").x.to_numpy()
        if len(values) < LEAST:
            return pd.DataFrame(columns=["by", "n", "draw", "v"])
        own = range(int(key[1]) * each, min(draws, (int(key[1]) + 1) * each))
        found = [float(fn(values[bootstrap_places(len(values), mean_block, np.random.default_rng([seed, k]))])) for k in own]
        if key[1] == 0:  # draw -1 is the series itself
            own, found = [-1, *own], [float(fn(values)), *found]
        return pd.DataFrame({"by": key[0], "n": len(values), "draw": list(own), "v": found})

    kind = seen.schema["by"].dataType.simpleString()
    made = dealt.groupBy("by", "deal").applyInPandas(run, f"by {kind}, n long, draw int, v double")
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    v = F.when((F.col("draw") >= 0) & finite, F.col("v"))
    return made.groupBy(F.col("by").alias(by), "n").agg(
        F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("point"), F.percentile(v, F.lit(alpha / 2)).alias("lower"), F.percentile(v, F.lit(1 - alpha / 2)).alias("upper"),
        F.stddev_samp(v).alias("spread"), F.avg((v > 0).cast("double")).alias("share_above_zero"), F.count(v).alias("drawn"),
    )
