"""Forecasts meet their labels later: one interval join for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORECAST = ["model", "symbol", "ts", "target_ts", "y_pred"]


def resolve_forecasts(forecasts: DataFrame, labels: DataFrame, patience: str = "10 days", lateness: str = "2 days", as_of=None) -> DataFrame:
    """model, symbol, ts, target_ts, y_pred, y_true, resolved_at of forecasts (model, symbol, ts, target_ts, y_pred).

    labels (symbol, target_ts, label_at, y_true) carry the instant at which each became known. A label counts if it
    becomes known no earlier than target_ts and at most `patience` after it; a forecast without such a label keeps null
    y_true and resolved_at. Forecasts must be made before their target; others are dropped. Labels given twice resolve a
    forecast twice, so pass corrections through last_arrivals first.

    On tables, as_of leaves out what a stream would still hold back at that instant: forecasts without a label whose
    patience is not over, and labels known later. On streams both sides have a watermark: rows up to `lateness` behind the newest of their side still
    count, a matched forecast is handed on at once, an unmatched one when both watermarks have passed its patience, and
    then its state is dropped. Use append mode.
    """
    # the watermark goes to a copy: on a join key it would drop a forecast's state as soon as it passed the target
    f = forecasts.select(*FORECAST, (F.col("target_ts") + F.expr("INTERVAL 0 SECONDS")).alias("__due")).where("target_ts > ts")
    known = labels.select(F.col("symbol").alias("__symbol"), F.col("target_ts").alias("__target"), F.col("label_at").alias("resolved_at"), "y_true")
    if forecasts.isStreaming or labels.isStreaming:
        f, known = f.withWatermark("__due", lateness), known.withWatermark("resolved_at", lateness)
    wait = F.expr(f"INTERVAL {patience}")
    timely = (F.col("resolved_at") >= F.col("__due")) & (F.col("resolved_at") <= F.col("__due") + wait)
    if as_of is not None:
        known = known.where(F.col("resolved_at") <= F.lit(as_of).cast("timestamp"))
    met = f.join(known, (F.col("symbol") == F.col("__symbol")) & (F.col("target_ts") == F.col("__target")) & timely, "left")
    found = met.select(*FORECAST, "y_true", "resolved_at")
    if as_of is not None:
        found = found.where(F.col("resolved_at").isNotNull() | (F.col("target_ts") + wait < F.lit(as_of).cast("timestamp")))
    return found
