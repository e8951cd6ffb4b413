"""Causal column functions: every value depends on its own row and earlier rows of the symbol alone.

A window that is not full gives null; nulls count as missing observations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERIODS = 252


def by_symbol():
    return W.partitionBy("symbol").orderBy("ts")


class LookAheadError(ValueError):
    """A causal function was asked for a future value."""


def _past(n: int) -> int:
    if n < 1:
        raise LookAheadError(f"a causal window needs at least one period, not {n}")
    return n


def trailing(n: int):
    return by_symbol().rowsBetween(1 - _past(n), 0)


def full(x: Column, n: int, value: Column) -> Column:
    """value where the last n rows all have x."""
    return F.when(F.count(x).over(trailing(n)) == n, value)


def lag(x: Column, n: int) -> Column:
    return F.lag(x, _past(n)).over(by_symbol())


def pct_change(x: Column, n: int = 1) -> Column:
    return F.try_divide(x, lag(x, n)) - 1


def log_return(x: Column, n: int = 1) -> Column:
    logs = F.when(x > 0, F.ln(x))
    return logs - lag(logs, n)


def rolling_mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(trailing(n)))


def rolling_std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x).over(trailing(n)))


def rolling_sum(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x).over(trailing(n)))


def rolling_min(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(trailing(n)))


def rolling_max(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(trailing(n)))


def rolling_skew(x: Column, n: int) -> Column:
    """Sample skewness with the usual bias correction."""
    return full(x, n, F.skewness(x).over(trailing(n)) * math.sqrt(n * (n - 1)) / (n - 2))


def rolling_kurtosis(x: Column, n: int) -> Column:
    """Sample excess kurtosis with the usual bias correction."""
    return full(x, n, ((n + 1) * F.kurtosis(x).over(trailing(n)) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def rolling_zscore(x: Column, n: int) -> Column:
    return F.try_divide(x - rolling_mean(x, n), F.nullif(rolling_std(x, n), F.lit(0.0)))


def realised_volatility(r: Column, n: int, periods: int = PERIODS) -> Column:
    return rolling_std(r, n) * math.sqrt(periods)


def downside_volatility(r: Column, n: int, periods: int = PERIODS) -> Column:
    """Volatility of the losses; gains and missing returns count as zero."""
    return rolling_std(F.when(r < 0, r).otherwise(F.lit(0.0)), n) * math.sqrt(periods)


def drawdown(x: Column, n: int | None = None) -> Column:
    """Distance below the highest value so far, or of the last n rows."""
    if n is None:
        return F.try_divide(x, F.max(x).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))) - 1
    return F.try_divide(x, rolling_max(x, n)) - 1


def forward_return(x: Column, horizon: int) -> Column:
    """A label, not a feature: the return from this row to the one `horizon` rows later."""
    return F.try_divide(F.lead(x, _past(horizon)).over(by_symbol()), x) - 1


#: Span of log weights within which sums of scaled means are kept; what is older than two spans weighs under e**-300.
SPAN = 300.0


def _carried(chunks: DataFrame, end: str, log: str, name: str) -> DataFrame:
    """chunks with the mean that each inherits from all chunks before it: a chunk takes m to exp(log) * m + end.

    Running log weights are cut into spans; a mean is put together from the sums of its own span and the one before, each
    scaled by where its span begins, so nothing overflows.
    """
    order = W.partitionBy("symbol").orderBy("__ewm_chunk")
    chunks = chunks.withColumn("__s", F.sum(log).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("__b", F.floor(-F.col("__s") / SPAN))
    chunks = chunks.withColumn("__e", F.col(end) * F.exp(-F.col("__s") - SPAN * F.col("__b")))
    own = F.sum("__e").over(W.partitionBy("symbol", "__b").orderBy("__ewm_chunk").rowsBetween(W.unboundedPreceding, 0))
    older = F.sum("__e").over(W.partitionBy("symbol").orderBy("__b").rangeBetween(-1, -1))
    scale = F.exp(F.col("__s") + SPAN * F.col("__b"))
    chunks = chunks.withColumn("__m", scale * own + F.coalesce(scale * math.exp(-SPAN) * older, F.lit(0.0)))
    return chunks.withColumn(name, F.coalesce(F.lag("__m").over(order), F.lit(0.0))).drop("__s", "__b", "__e", "__m")


def ewm(df: DataFrame, sources: dict[str, tuple[str, float, int]]) -> DataFrame:
    """df with recursive exponential means: name -> (column, alpha, observations needed); all sources in one pass.

    A step of the recursion is an affine map of the mean before, and maps compose: each symbol is cut into chunks of rows
    within which the maps are summed up by windows, every chunk's map is one row, and each chunk inherits the composition
    of all chunks before it. Missing observations keep the mean and age it, as the weights of the next observation show.
    """
    time = by_symbol()
    past, earlier = time.rowsBetween(W.unboundedPreceding, 0), time.rowsBetween(W.unboundedPreceding, -1)
    wanes = {k: min(-math.log1p(-alpha), 40.0) if alpha < 1 else 40.0 for k, (_, alpha, _) in enumerate(sources.values())}
    size = max(8, math.ceil(20 / max(wanes.values())))
    rows = df.withColumn("__ewm_i", F.row_number().over(time) - 1).withColumn("__ewm_chunk", F.floor(F.col("__ewm_i") / size))
    seen = {k: F.col(f"`{column}`").isNotNull() for k, (column, _, _) in enumerate(sources.values())}
    i = F.col("__ewm_i")
    rows = rows.withColumns({f"__ewm_before{k}": F.last(F.when(s, i), ignorenulls=True).over(earlier) for k, s in seen.items()} | {f"__ewm_n{k}": F.count(F.when(s, 1)).over(past) for k, s in seen.items()})
    steps = {}
    for k, (column, alpha, _) in enumerate(sources.values()):
        x, gap = F.col(f"`{column}`").cast("double"), i - F.col(f"__ewm_before{k}")
        old, later = F.exp(F.greatest(-wanes[k] * gap, F.lit(-SPAN))), gap.isNotNull()
        # mean = factor * mean before + part; the first observation is the mean
        steps[f"__ewm_log{k}"] = F.when(seen[k] & later, F.ln(old / (old + alpha))).otherwise(0.0)
        steps[f"__ewm_part{k}"] = F.when(seen[k] & later, alpha * x / (old + alpha)).when(seen[k], x).otherwise(0.0)
    rows = rows.withColumns(steps)
    inner = W.partitionBy("symbol", "__ewm_chunk").orderBy("__ewm_i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__ewm_log{k}": F.sum(f"__ewm_log{k}").over(inner) for k in wanes})
    rows = rows.withColumns({f"__ewm_own{k}": F.exp(f"__ewm_log{k}") * F.sum(F.col(f"__ewm_part{k}") * F.exp(-F.col(f"__ewm_log{k}"))).over(inner) for k in wanes})
    ends = [F.max_by(f"__ewm_{what}{k}", "__ewm_i").alias(f"__{what}{k}") for k in wanes for what in ("own", "log")]
    chunks = rows.groupBy("symbol", "__ewm_chunk").agg(*ends)
    for k in wanes:
        chunks = _carried(chunks, f"__own{k}", f"__log{k}", f"__ewm_inherited{k}")
    rows = rows.join(chunks.select("symbol", "__ewm_chunk", *(f"__ewm_inherited{k}" for k in wanes)), ["symbol", "__ewm_chunk"])
    rows = rows.withColumns({f"__ewm_mean{k}": F.when(seen[k], F.exp(f"__ewm_log{k}") * F.col(f"__ewm_inherited{k}") + F.col(f"__ewm_own{k}")) for k in wanes})
    means = {name: F.when(F.col(f"__ewm_n{k}") >= least, F.last(f"__ewm_mean{k}", ignorenulls=True).over(past)) for k, (name, (_, _, least)) in enumerate(sources.items())}
    return rows.withColumns(means).select(*(F.col(f"`{c}`") for c in df.columns if c not in means), *means)


def ewm_mean(df: DataFrame, column: str, span: int, name: str = "ewm") -> DataFrame:
    return ewm(df, {name: (column, 2 / (span + 1), span)})


def _gains(column: str) -> dict[str, Column]:
    change = F.col(column) - lag(F.col(column), 1)
    return {"__up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "__down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}


def _strength() -> Column:
    gain, loss = F.col("__gain"), F.col("__loss")
    return F.when((gain == 0) & (loss == 0), None).when(loss == 0, 100.0).when(gain == 0, 0.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))


def _true_range() -> Column:
    before = lag(F.col("close"), 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rsi(df: DataFrame, column: str, n: int = 14, name: str = "rsi") -> DataFrame:
    """Relative strength by Wilder's means: 100 without losses, 0 without gains, null without either."""
    rows = ewm(df.withColumns(_gains(column)), {"__gain": ("__up", 1 / n, n), "__loss": ("__down", 1 / n, n)})
    return rows.withColumn(name, _strength()).drop("__up", "__down", "__gain", "__loss")


def average_true_range(df: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    """Wilder's mean of the true range; a symbol's first bar has its high minus its low."""
    return ewm(df.withColumn("__range", _true_range()), {name: ("__range", 1 / n, n)}).drop("__range")


def rsi_and_range(df: DataFrame, column: str, n: int = 14, rsi_name: str = "rsi", range_name: str = "atr") -> DataFrame:
    """df with both, in one pass."""
    rows = df.withColumns(_gains(column) | {"__range": _true_range()})
    rows = ewm(rows, {"__gain": ("__up", 1 / n, n), "__loss": ("__down", 1 / n, n), range_name: ("__range", 1 / n, n)})
    return rows.withColumn(rsi_name, _strength()).drop("__up", "__down", "__gain", "__loss", "__range")
