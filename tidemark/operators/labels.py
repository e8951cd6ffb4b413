"""Labels with their own availability, stored returns, and purged walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import causal as c
from .quality import require_columns
from .relational import one_to_one


def forward_labels(bars: DataFrame, horizon: int = 5, price: str = "adj_close", classification: bool = False) -> DataFrame:
    """symbol, ts, available_at, label_available_at, label: the return (or its sign as 0/1) over the next bars."""
    y = c.forward_return(F.col(price), horizon)
    label = F.when(y > 0, 1.0).when(y.isNotNull(), 0.0) if classification else y
    made = bars.select("symbol", "ts", "available_at", F.lead("available_at", horizon).over(c.by_symbol()).alias("label_available_at"), label.alias("label"))
    return made.where(F.col("label").isNotNull())


def stored_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), price: str = "adj_close", method: str = "simple") -> DataFrame:
    """Trailing and forward returns (simple or log) in long form; a forward return is known when its far end is."""
    if method not in ("simple", "log"):
        raise ValueError(f"unknown method {method}")
    p = F.col(price)
    kind = (lambda x: x) if method == "simple" else (lambda x: F.when(x > -1, F.log1p(x)))
    rows = [F.struct(F.lit(h).alias("horizon"), F.lit("trailing").alias("direction"), kind(c.pct_change(p, h)).alias("value"), F.col("available_at").alias("known")) for h in horizons]
    rows += [F.struct(F.lit(h).alias("horizon"), F.lit("forward").alias("direction"), kind(c.forward_return(p, h)).alias("value"), F.lead("available_at", h).over(c.by_symbol()).alias("known")) for h in horizons]
    long = bars.select("symbol", "ts", F.array(*rows).alias("xs")).select("symbol", "ts", F.explode("xs").alias("x"))
    return long.select("symbol", "ts", "x.horizon", "x.direction", "x.value", F.col("x.known").alias("available_at")).where("value is not null")


def training_frame(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """symbol, ts, available_at, label_available_at, the features and label: rows that have all features and a label.

    Features and labels meet one to one; a key that is repeated on either side is refused (relational.JoinError).
    """
    require_columns(features, ["symbol", "ts", "available_at", *names])
    require_columns(labels, ["symbol", "ts", "label_available_at", "label"])
    both = one_to_one(features.select("symbol", "ts", "available_at", *names), labels.select("symbol", "ts", "label_available_at", "label"), ["symbol", "ts"])
    return both.dropna(subset=names).select("symbol", "ts", "available_at", "label_available_at", *names, "label")


def fold_bounds(n: int, kind: str = "expanding", splits: int = 5, test: int = 126, train: int = 504) -> list[tuple[int, int, int, int]]:
    """(fold, first training date, first test date, last test date) as positions on the timeline; the last fold ends it."""
    if kind == "holdout":
        return [(0, 0, n - test, n - 1)] if n - test >= train // 4 else []
    folds = min(splits, (n - train) // test)
    bounds = []
    for k in range(max(0, folds)):
        start = n - (folds - k) * test
        bounds.append((k, 0 if kind == "expanding" else max(0, start - train), start, start + test - 1))
    return bounds


def folds(rows: DataFrame, kind: str = "expanding", splits: int = 5, test: int = 126, train: int = 504, embargo_days: int = 0, purge: bool = True) -> DataFrame:
    """rows with fold and role (train, test, purged, embargoed); rows have ts and label_available_at."""
    timeline = rows.select("ts").distinct().withColumn("place", F.row_number().over(W.orderBy("ts")) - 1)
    n = rows.select("ts").distinct().count()
    spark = rows.sparkSession
    bounds = spark.createDataFrame(fold_bounds(n, kind, splits, test, train), "fold int, first int, start int, end int")
    edges = bounds.join(timeline.select(F.col("place").alias("start"), F.col("ts").alias("test_from")), "start")
    placed = rows.join(timeline, "ts").join(F.broadcast(edges), (F.col("place") >= F.col("first")) & (F.col("place") <= F.col("end")))
    early = F.col("test_from") - F.make_interval(days=F.lit(embargo_days))
    role = (
        F.when(F.col("place") >= F.col("start"), "test")
        .when(F.lit(embargo_days > 0) & (F.col("ts") > early), "embargoed")
        .when(F.lit(purge) & (F.col("label_available_at") >= F.col("test_from")), "purged")
        .otherwise("train")
    )
    return placed.select(*rows.columns, "fold", role.alias("role"))
