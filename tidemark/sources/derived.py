"""Market views over the driver's tables: bars from orders, macro series from lineitem, memberships and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lag between a bar's date and the instant at which it is known.
BAR_LAG = "INTERVAL 21 HOURS"
MACRO_LAG = "INTERVAL '45 13:30:00' DAY TO SECOND"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, available_at, open, high, low, close, adj_close, volume."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("timestamp")
    made = orders.groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return made.select(
        "symbol", "ts", (F.col("ts") + F.expr(BAR_LAG)).alias("available_at"), "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume"
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, ts, available_at, value: monthly means of extended prices by return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    made = lines.groupBy(F.col("l_returnflag").alias("code"), month.alias("ts")).agg(F.avg("l_extendedprice").alias("value"))
    return made.select("code", "ts", (F.col("ts") + F.expr(MACRO_LAG)).alias("available_at"), "value")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, valid_from, valid_to: quarters in which a symbol has at least the mean number of orders."""
    quarter = F.date_trunc("quarter", "ts")
    counts = bars(spark, sf_dir).groupBy("symbol", quarter.alias("valid_from")).agg(F.sum("volume").alias("n"))
    last = F.max("valid_from").over(W.partitionBy())
    kept = counts.withColumn("mean", F.avg("n").over(W.partitionBy("valid_from"))).withColumn("last", last).where("n >= mean")
    end = F.when(F.col("valid_from") < F.col("last"), F.add_months("valid_from", 3).cast("timestamp"))
    return kept.select("symbol", "valid_from", end.alias("valid_to"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, symbol, ts, available_at, target_ts, y_pred, y_true: three simple forecasts of the next bar's return."""
    w = W.partitionBy("symbol").orderBy("ts")
    b = bars(spark, sf_dir).withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1)
    b = b.withColumn("hist", F.avg("r").over(w.rowsBetween(-20, 0))).withColumn("n", F.count("r").over(w.rowsBetween(-20, 0)))
    b = b.withColumn("y_true", F.lead("r").over(w)).withColumn("target_ts", F.lead("available_at").over(w))
    b = b.where((F.col("n") == 21) & F.col("y_true").isNotNull())
    models = F.array(*(F.struct(F.lit(m).alias("model"), p.cast("double").alias("y_pred")) for m, p in (("hist21", F.col("hist")), ("last1", F.col("r")), ("zero", F.lit(0.0)))))
    return b.select(F.explode(models).alias("m"), "symbol", "ts", "available_at", "target_ts", "y_true").select("m.model", "symbol", "ts", "available_at", "target_ts", "m.y_pred", "y_true")


#: The same views for the oracle.
SQL = """
bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 21 HOUR AS available_at,
  arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
  arg_max(o_totalprice, o_orderkey) AS adj_close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2, 3),
macro AS (SELECT l_returnflag AS code, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts,
  CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) + INTERVAL 45 DAY + INTERVAL 13 HOUR + INTERVAL 30 MINUTE AS available_at,
  avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3),
membership AS (SELECT symbol, valid_from, CASE WHEN valid_from < last THEN CAST(valid_from + INTERVAL 3 MONTH AS TIMESTAMP) END AS valid_to FROM (
  SELECT *, avg(n) OVER (PARTITION BY valid_from) AS mean, max(valid_from) OVER () AS last FROM (
    SELECT symbol, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS valid_from, sum(volume) AS n FROM bars GROUP BY 1, 2)) WHERE n >= mean),
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),
preds AS (SELECT m.model, symbol, ts, available_at, target_ts, CASE m.model WHEN 'hist21' THEN hist WHEN 'last1' THEN r ELSE 0.0 END AS y_pred, y_true FROM (
  SELECT *, avg(r) OVER w21 AS hist, count(r) OVER w21 AS n, lead(r) OVER w AS y_true, lead(available_at) OVER w AS target_ts FROM rets
  WINDOW w AS (PARTITION BY symbol ORDER BY ts), w21 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
  (VALUES ('hist21'), ('last1'), ('zero')) m(model) WHERE n = 21 AND y_true IS NOT NULL)
"""
