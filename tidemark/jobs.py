"""Jobs that can be run again: ingestion behind the quality gate, stored returns, features, training."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, labels, models, quality, registry, relational, runs
from .sources import archive, landing

OVERLAP_DAYS = 5


def _merge(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> None:
    """Replaces or adds the rows of new in the table at path, which is partitioned by month; other months stay untouched."""
    if new.isEmpty():
        return
    new = new.withColumn("month", F.date_format("ts", "yyyyMM").cast("int"))
    known = registry.stored(spark, path)
    if known is not None:
        touched = known.join(new.select("month").distinct(), "month", "left_semi")
        new = relational.upsert(touched.select(*new.columns), new, key)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def _ingest(spark: SparkSession, rows: DataFrame, report: DataFrame, path: str, entity: str) -> DataFrame:
    """One status row per entity: loaded, unchanged or failed, with the rows read and loaded; kept in a log beside the table.

    Rows older than the entity's newest stored one, less an overlap for revisions, are not loaded again.
    An entity that fails a check is not loaded; the others are.
    """
    known = registry.stored(spark, path)
    counted = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_read"))
    bad = report.where("status = 'FAIL'").groupBy(F.col("entity").alias(entity)).agg(F.sort_array(F.collect_set("check_name")).alias("failed"))
    fresh = rows.join(bad, entity, "left_anti")
    if known is not None:
        since = known.groupBy(entity).agg((F.max("ts") - F.make_dt_interval(days=F.lit(OVERLAP_DAYS))).alias("__since"))
        fresh = fresh.join(since, entity, "left").where("__since is null or ts >= __since").drop("__since")
    loaded = fresh.groupBy(entity).agg(F.count(F.lit(1)).alias("n_loaded"))
    status = F.when(F.col("failed").isNotNull(), "failed").when(F.col("n_loaded") == 0, "unchanged").otherwise("loaded")
    got = counted.join(loaded, entity, "left").join(bad, entity, "left").fillna(0, ["n_loaded"]).withColumn("status", status)
    # written first, since the merge changes what it is computed from
    log = f"{path}_log/{uuid.uuid4().hex}"
    got.write.parquet(log)
    _merge(spark, fresh, path, [entity, "ts"])
    return spark.read.parquet(log)


def ingest_prices(spark: SparkSession, files: str, path: str) -> DataFrame:
    """Loads landing files of bars into the table at path; see _ingest for what it returns."""
    rows = landing.read_prices(spark, files, arrived=True)
    return _ingest(spark, rows.drop("arrived"), quality.price_report(rows, arrival="arrived"), path, "symbol")


def archive_prices(spark: SparkSession, files: str, root: str, provider: str = "landing", dataset: str = "prices") -> int:
    """Puts landing files into the raw archive at root as they are, and returns how many were new."""
    return archive.write(archive.read_files(spark, files, provider, dataset), root)


def ingest_archive(spark: SparkSession, root: str, path: str, provider: str = "landing", dataset: str = "prices") -> DataFrame:
    """Loads the bars of archived payloads, in the order in which they were fetched, into the table at path; the later of two rows of a key counts."""
    rows = landing.parse_prices(archive.read(spark, root, provider, dataset))
    newest = relational.dedup_keep_last(rows, ["symbol", "ts"], "arrived")
    return _ingest(spark, newest.drop("arrived"), quality.price_report(newest), path, "symbol")


def ingest_series(spark: SparkSession, files: str, path: str) -> DataFrame:
    """Loads landing files of series into the table at path; see _ingest for what it returns."""
    rows = landing.read_series(spark, files)
    return _ingest(spark, rows, quality.macro_report(rows), path, "code")


def materialise_returns(bars: DataFrame, path: str, horizons: tuple[int, ...] = (1, 5, 21)) -> int:
    """Writes trailing and forward returns anew and returns their number."""
    labels.stored_returns(bars, horizons).write.mode("overwrite").partitionBy("direction", "horizon").parquet(path)
    return bars.sparkSession.read.parquet(path).count()


def generate_features(bars: DataFrame, path: str, feature_set: registry.FeatureSet) -> int:
    """Adds the price features of a set to the long table at path and returns the number of new values."""
    made = features.price_features(bars).select("symbol", "ts", "available_at", *(f.name for f in feature_set.features))
    return registry.persist(feature_set, made, path)


def train(bars: DataFrame, path: str, names: list[str], horizon: int = 5, splits: int = 5, test: int = 126, least: int = 504) -> str:
    """Walks the linear models and the baselines forward over some price features and stores the run; returns its id."""
    rows = labels.forward_labels(bars, horizon).join(features.price_features(bars).select("symbol", "ts", *names), ["symbol", "ts"]).dropna()
    config = {"features": sorted(names), "horizon": horizon, "splits": splits, "test": test, "train": least}
    run = runs.run_id(config, rows.select("symbol", "ts", *names, "label"))
    dealt = labels.folds(rows, splits=splits, test=test, train=least)
    runs.persist({"predictions": models.walk_forward(dealt, names)}, path, run, config)
    return run
