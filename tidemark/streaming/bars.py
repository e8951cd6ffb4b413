"""Bars from ticks; the same plan serves a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, width: str = "1 day", lateness: str = "5 days") -> DataFrame:
    """symbol, start, open, high, low, close, ticks per tumbling window of ticks (symbol, ts, value).

    On a stream, ticks up to `lateness` behind the newest still change their bar, later ones are dropped.
    """
    rows = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    made = rows.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("ticks")
    )
    return made.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def upsert_batches(stream: DataFrame, key: list[str], apply, checkpoint: str):
    """Starts a query that hands each micro-batch, one row per key by its last arrival, to apply(batch, number)."""

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), "ingest_seq").alias("x")).select("x.*")
        apply(last, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gated_bars(ticks: DataFrame, width: str = "1 hour", lag: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """tick_bars with stop (its end) and available_at (stop plus lag), only those that may be acted upon: the decision gate at a bar's close.

    A bar is handed on once, when the newest tick is `lateness` past its available_at, so no tick that is still accepted
    can change it and nothing decides on it before it is available. On a stream this is append mode: the watermark stays
    lag and lateness behind the newest tick. On a table the newest tick of all says which bars are ready, so a table and a
    stream that has read it hand on the same bars. Null instants, symbols and values are no ticks.
    """
    wait, behind = F.expr(f"INTERVAL {lag}"), F.expr(f"INTERVAL {lateness}")
    rows = ticks.where("ts IS NOT NULL AND symbol IS NOT NULL AND value IS NOT NULL")
    if ticks.isStreaming:
        made = tick_bars(rows, width, _sum_of(ticks, lag, lateness))
    else:
        newest = rows.agg(F.max("ts").alias("newest"))  # one row
        made = tick_bars(rows, width).join(F.broadcast(newest), F.col("start") + F.expr(f"INTERVAL {width}") + wait + behind <= F.col("newest")).drop("newest")
    end = F.col("start") + F.expr(f"INTERVAL {width}")
    return made.select("symbol", "start", end.alias("stop"), (end + wait).alias("available_at"), "open", "high", "low", "close", "ticks")


def _sum_of(df: DataFrame, *lengths: str) -> str:
    """The sum of lengths of time, in milliseconds, as a watermark takes it."""
    total = " + ".join(f"unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {x})" for x in lengths)
    return f"{df.sparkSession.sql(f'SELECT ({total}) div 1000').first()[0]} milliseconds"
