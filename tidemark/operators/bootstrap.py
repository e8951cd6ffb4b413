"""Confidence intervals by the stationary bootstrap, from running sums and block ends alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAST = 30


def _share(kind: str, seed: int) -> Column:
    """A number in [0, 1) that follows from the seed, the draw and the place."""
    digest = F.md5(F.concat_ws(":", F.lit(kind), F.lit(str(seed)), F.col("draw").cast("string"), F.col("i").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def block_ends(counts: DataFrame, by: str, draws: int, mean_block: float, seed: int) -> DataFrame:
    """(by, n, draw, place, sign, wraps): each block of each draw adds the running sum at its end and takes off that before it.

    Block lengths are geometric with the given mean; a block that passes the last value goes on at the first, which
    `wraps` counts.
    """
    many = counts.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).repartition(by, "draw")
    places = many.select(by, "n", "draw", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    cuts = places.where((F.col("i") == 0) | (_share("cut", seed) < 1 / max(mean_block, 1.0)))
    until = F.coalesce(F.lead("i").over(W.partitionBy(by, "draw").orderBy("i")), F.col("n"))
    blocks = cuts.select(by, "n", "draw", F.floor(_share("start", seed) * F.col("n")).alias("start"), (until - F.col("i")).alias("length"))
    end = F.col("start") + F.col("length")
    wraps = (end > F.col("n")).cast("long")
    sides = F.array(
        F.struct(F.col("start").alias("place"), F.lit(-1.0).alias("sign"), F.lit(0).cast("long").alias("wraps")),
        F.struct((end - F.col("n") * wraps).alias("place"), F.lit(1.0).alias("sign"), wraps.alias("wraps")),
    )
    return blocks.select(by, "n", "draw", F.explode(sides).alias("s")).select(by, "n", "draw", "s.*")


def stationary_bootstrap(rows: DataFrame, x: str = "r", by: str = "symbol", order: str = "ts", statistic: str = "sharpe", draws: int = 1000, mean_block: float = 20.0, alpha: float = 0.05, seed: int = 0, periods: int = 252) -> DataFrame:
    """by, n, point, lower, upper, spread and share_above_zero of the mean or the yearly Sharpe ratio of each group's series.

    A draw's sums are differences of running sums at the ends of its blocks, so a draw costs its blocks and not its
    values. The draws follow from the seed. Groups of fewer than 30 values are left out.
    """
    if statistic not in ("mean", "sharpe"):
        raise ValueError(f"unknown statistic {statistic}")
    value = F.col(x).cast("double")
    seen = rows.where(value.isNotNull() & ~F.isnan(value)).select(by, F.col(order).alias("__at"), value.alias("x"))
    totals = seen.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("all_1"), F.sum(F.col("x") ** 2).alias("all_2")).where(F.col("n") >= LEAST)
    w = W.partitionBy(by).orderBy("__at")
    until = w.rowsBetween(W.unboundedPreceding, 0)
    sums = seen.select(by, F.row_number().over(w).cast("long").alias("place"), F.sum("x").over(until).alias("s_1"), F.sum(F.col("x") ** 2).over(until).alias("s_2"))
    ends = block_ends(totals.select(by, "n"), by, draws, mean_block, seed)
    # before the first value the sums are zero, which the left join leaves out
    met = ends.join(sums, [by, "place"], "left").groupBy(by, "n", "draw").agg(
        *(F.coalesce(F.sum(F.col("sign") * F.col(f"s_{k}")), F.lit(0.0)).alias(f"s_{k}") for k in (1, 2)), F.sum("wraps").alias("wraps")
    )
    drawn = met.join(totals.drop("n"), by)
    drawn = drawn.select(by, "n", *((F.col(f"s_{k}") + F.col("wraps") * F.col(f"all_{k}")).alias(f"s_{k}") for k in (1, 2)))
    n = F.col("n")

    def measure(first: str, second: str) -> Column:
        mean = F.col(first) / n
        if statistic == "mean":
            return mean
        sd = F.sqrt(F.greatest(F.col(second) - n * mean**2, F.lit(0.0)) / (n - 1))
        return F.when(sd > 1e-12, mean / sd * periods**0.5)

    got = drawn.select(by, measure("s_1", "s_2").alias("v")).where("v is not null").groupBy(by).agg(
        F.percentile("v", F.lit(alpha / 2)).alias("lower"), F.percentile("v", F.lit(1 - alpha / 2)).alias("upper"),
        F.stddev_samp("v").alias("spread"), F.avg((F.col("v") > 0).cast("double")).alias("share_above_zero"),
    )
    return totals.select(by, "n", measure("all_1", "all_2").alias("point")).join(got, by)
