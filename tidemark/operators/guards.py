"""Guards against look-ahead: a harness that bends the future and looks whether the past moves, and order checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.causal import LookAheadError


def _numeric(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal")]


def corrupt_future(df: DataFrame, cut, columns: list[str] | None = None, lost: float = 0.3, magnitude: float = 3.0, seed: int = 7) -> DataFrame:
    """df whose numbers after the instant `cut` are moved far to either side of their column's mean, and some made null."""
    columns = _numeric(df) if columns is None else columns
    means = df.agg(*(F.avg(F.col(c)).alias(f"__m_{c}") for c in columns))
    rows = df.crossJoin(F.broadcast(means))  # one row
    out = rows
    for k, c in enumerate(columns):
        chance = lambda salt: F.pmod(F.xxhash64("ts", F.lit(f"{seed}/{k}/{salt}"), F.col(c)), F.lit(1000)) / 1000  # noqa: B023, E731
        side = F.when(chance("side") < 0.5, -magnitude).otherwise(magnitude)
        bent = F.when(chance("lost") >= lost, F.col(f"__m_{c}") + side * (F.col(c) - F.col(f"__m_{c}") + 1))
        out = out.withColumn(f"__b_{c}", F.when(F.col("ts") > F.lit(cut), bent).otherwise(F.col(c)))
    return out.select(*(F.col(f"__b_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def punch_gap(df: DataFrame, cut, width: int = 3, columns: list[str] | None = None, by: str = "symbol") -> DataFrame:
    """df whose last `width` rows up to the cut have null numbers, so that filling backwards shows."""
    columns = _numeric(df) if columns is None else columns
    place = F.row_number().over(W.partitionBy(by, F.col("ts") <= F.lit(cut)).orderBy(F.desc("ts")))
    hole = (F.col("ts") <= F.lit(cut)) & (F.col("__place") <= width)
    rows = df.withColumn("__place", place)
    return rows.select(*(F.when(~hole, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def leakage_findings(compute: Callable[[DataFrame], DataFrame], df: DataFrame, cuts: tuple[float, ...] = (0.4, 0.6, 0.85), by: str = "symbol", tolerance: float = 1e-6, floor: float = 1e-9, gap: int = 3) -> DataFrame:
    """feature, cut, n_changed, largest: features of compute(df) at or before a cut that change when what follows does.

    compute keeps by and ts and returns one row per row. The cuts are shares of the timeline. A change counts beyond
    `tolerance` standard deviations of the feature before the cut, and wherever a value is null on one side alone.
    """
    instants = [r[0] for r in df.select(F.percentile(F.unix_micros("ts"), F.array(*map(F.lit, cuts))).alias("x")).select(F.explode("x")).collect()]
    found = None
    for share, at in zip(cuts, instants, strict=True):
        cut = F.timestamp_micros(F.lit(int(at)))
        for probe in [df, punch_gap(df, cut, gap, by=by)] if gap else [df]:
            clean, bent = compute(probe), compute(corrupt_future(probe, cut))
            names = [c for c in clean.columns if c not in (by, "ts")]
            both = clean.where(F.col("ts") <= cut).join(bent.select(by, "ts", *(F.col(c).alias(f"__x_{c}") for c in names)), [by, "ts"])
            scales = clean.where(F.col("ts") <= cut).agg(*(F.greatest(F.coalesce(F.stddev_pop(F.col(c).try_cast("double")), F.lit(0.0)) * tolerance, F.lit(floor)).alias(f"__s_{c}") for c in names))
            rows = both.crossJoin(F.broadcast(scales))  # one row
            parts = []
            for c in names:
                a, b = F.col(c), F.col(f"__x_{c}")
                d = F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")), F.lit(float("inf")))
                moved = ~a.eqNullSafe(b) & (a.isNull() | b.isNull() | (d > F.col(f"__s_{c}")))
                parts.append(F.struct(F.lit(c).alias("feature"), F.count_if(moved).alias("n_changed"), F.max(F.when(moved, d)).alias("largest")))
            made = rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.feature", F.lit(share).alias("cut"), "x.n_changed", "x.largest").where("n_changed > 0")
            found = made if found is None else found.unionByName(made)
    return found.groupBy("feature", "cut").agg(F.max("n_changed").alias("n_changed"), F.max("largest").alias("largest"))


def assert_causal(compute: Callable[[DataFrame], DataFrame], df: DataFrame, **how) -> None:
    """Raises LookAheadError with the features that see the future."""
    found = leakage_findings(compute, df, **how).orderBy("feature", "cut").collect()
    if found:
        raise LookAheadError("; ".join(f"{r.feature} at {r.cut}: {r.n_changed} rows changed" for r in found))


def assert_availability_ordering(df: DataFrame, label: str = "frame") -> DataFrame:
    """df, if no row is available before its instant."""
    if not {"ts", "available_at"} <= set(df.columns):
        raise LookAheadError(f"{label} lacks ts or available_at")
    early = df.where(F.col("available_at") < F.col("ts")).count()
    if early:
        raise LookAheadError(f"{label}: {early} rows are available before their instant")
    return df


def assert_split_ordering(dealt: DataFrame, embargo_days: int = 0) -> DataFrame:
    """dealt (fold, role, ts), if in every fold the first test instant lies more than the embargo after the last training one."""
    edges = dealt.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("last"), F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("first"))
    wrong = edges.where(F.col("first") <= F.col("last") + F.make_dt_interval(days=F.lit(embargo_days))).orderBy("fold").collect()
    if wrong:
        raise LookAheadError(f"folds {[r.fold for r in wrong]}: the test begins before training and embargo end")
    return dealt
