"""Data-quality checks: one pass of aggregates per entity, then one row per check."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import causal as c


class SchemaError(ValueError):
    """A frame lacks required columns."""


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [x for x in required if x not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def _report(df: DataFrame, entity: str, checks: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """checks: name -> (observed, holds, status when it does not)."""
    rows = [F.struct(F.lit(k).alias("check_name"), observed.cast("double").alias("observed"), F.when(holds, "PASS").otherwise(bad).alias("status")) for k, (observed, holds, bad) in checks.items()]
    return df.select(F.col(entity).alias("entity"), F.explode(F.array(*rows)).alias("x")).select("entity", "x.*")


def _out_of_order(entity: str, arrival: str) -> Column:
    """Whether the row that arrived just before, in the order of the arrival column, has a later ts."""
    return F.coalesce(F.lag("ts").over(c.W.partitionBy(entity).orderBy(arrival)) > F.col("ts"), F.lit(False))


def price_report(bars: DataFrame, most_missing: float = 0.02, jump: float = 0.5, gap_days: int = 7, arrival: str = "available_at") -> DataFrame:
    """Nine checks per symbol. FAIL: too few rows, repeated keys, order, availability, high/low, signs; WARN: the rest.

    Rows have no order of their own in a table; monotonic_time holds if ts never goes back in the order of `arrival`.
    """
    prices = ["open", "high", "low", "close", "adj_close"]
    move = F.abs(c.pct_change(F.col("close")))
    rows = bars.withColumn("__move", move).withColumn("__gap", F.datediff("ts", F.lag("ts").over(c.by_symbol()))).withColumn("__same", (F.lag("ts").over(c.by_symbol()) == F.col("ts")).cast("int")).withColumn("__back", _out_of_order("symbol", arrival))
    odd = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    n = F.count(F.lit(1))
    got = rows.groupBy("symbol").agg(
        n.alias("n"),
        F.sum(F.coalesce("__same", F.lit(0))).alias("repeated"),
        F.count_if("__back").alias("disorder"),
        F.count_if(F.col("available_at") < F.col("ts")).alias("early"),
        F.count_if(odd).alias("odd"),
        sum((F.count_if(F.col(p) <= 0) for p in prices), F.lit(0)).alias("signs"),
        F.greatest(*(F.avg(F.col(p).isNull().cast("double")) for p in [*prices, "volume"])).alias("missing"),
        F.count_if(F.col("__move") > jump).alias("jumps"),
        F.count_if(F.col("__gap") > gap_days).alias("gaps"),
    )
    zero = lambda x: (F.col(x), F.col(x) == 0, "FAIL")
    enough = F.col("n") >= 3
    return _report(got, "symbol", {
        "row_count": (F.col("n"), F.col("n") >= 1, "FAIL"), "no_duplicates": zero("repeated"), "monotonic_time": zero("disorder"),
        "availability": zero("early"), "ohlc_consistency": zero("odd"), "positive_prices": zero("signs"),
        "missing_values": (F.col("missing"), F.col("missing") <= most_missing, "WARN"),
        "extreme_returns": (F.col("jumps"), enough & (F.col("jumps") == 0), "WARN"), "calendar_gaps": (F.col("gaps"), enough & (F.col("gaps") == 0), "WARN"),
    })


def macro_report(macro: DataFrame, most_missing: float = 0.2, arrival: str = "available_at") -> DataFrame:
    """Five checks per series."""
    w = c.W.partitionBy("code").orderBy("ts")
    rows = macro.withColumn("__same", (F.lag("ts").over(w) == F.col("ts")).cast("int")).withColumn("__back", _out_of_order("code", arrival))
    got = rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("__same", F.lit(0))).alias("repeated"), F.count_if("__back").alias("disorder"),
        F.count_if(F.col("available_at") < F.col("ts")).alias("early"), F.avg(F.col("value").isNull().cast("double")).alias("missing"),
    )
    zero = lambda x: (F.col(x), F.col(x) == 0, "FAIL")
    return _report(got, "code", {
        "row_count": (F.col("n"), F.col("n") >= 1, "FAIL"), "no_duplicates": zero("repeated"), "monotonic_time": zero("disorder"),
        "availability": zero("early"), "missing_values": (F.col("missing"), F.col("missing") <= most_missing, "WARN"),
    })


def freshness(bars: DataFrame, now: Column, max_age_days: int = 5) -> DataFrame:
    """Age in days of each symbol's newest bar, and whether it is too old."""
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("newest"))
    age = F.datediff(now, "newest")
    return newest.select("symbol", "newest", age.alias("age_days"), (age > max_age_days).alias("stale"))


class StaleData(ValueError):
    """The newest data is too old to go on."""


def assert_fresh(bars: DataFrame, now: Column, max_age_days: int = 5) -> DataFrame:
    """bars, if the newest of all is fresh; raises StaleData otherwise (an empty table is stale).

    Single symbols whose newest bar is too old only give a warning: a delisted one must not hold up the others.
    """
    ages = freshness(bars, now, max_age_days)
    all_of = ages.agg(F.min("age_days").alias("age"), F.count_if("stale").alias("n")).first()
    if all_of.age is None or all_of.age > max_age_days:
        raise StaleData("no rows" if all_of.age is None else f"the newest bar is {all_of.age} days old")
    if all_of.n:
        oldest = ages.where("stale").orderBy(F.desc("age_days"), "symbol").limit(10).collect()
        warnings.warn(f"{all_of.n} stale symbols: " + "; ".join(f"{r.symbol} {r.age_days} days" for r in oldest), stacklevel=2)
    return bars


def validate_stored(bars: DataFrame, symbols: DataFrame, now: Column, max_age_days: int = 7) -> DataFrame:
    """symbol, n, age_days, status of every symbol that should be stored: FAIL without rows, WARN when its newest is too old."""
    kept = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.datediff(now, F.max("ts")).alias("age_days"))
    got = symbols.select("symbol").distinct().join(kept, "symbol", "left").fillna(0, ["n"])
    return got.withColumn("status", F.when(F.col("n") == 0, "FAIL").when(F.col("age_days") > max_age_days, "WARN").otherwise("PASS"))
