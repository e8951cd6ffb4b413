"""Runs: hashes of their configuration and data, and their tables under a run's id."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import stored

MANIFESTS = "manifests"


def config_hash(config: dict) -> str:
    """The same for equal configurations, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def slug(text: Column) -> Column:
    """Text that can be part of a path: runs of other characters become one underscore, and what would be empty is unknown."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._=-]+", "_"), r"^_+|_+$", "")
    return F.when(clean == "", "unknown").otherwise(clean)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, total, mix): the number of rows and the sum and exclusive or of their digests, whatever their order.

    A repeated row changes the sum. Nulls differ from empty text.
    """
    cells = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)))
    digest = F.conv(F.substring(F.md5(cells), 1, 15), 16, 10).cast("long")
    return df.select(digest.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d").cast("decimal(20,0)")).cast("string").alias("total"), F.coalesce(F.bit_xor("d"), F.lit(0)).alias("mix"))


def run_id(config: dict, data: DataFrame, seed: int = 0) -> str:
    """Equal for the same configuration, the same rows and columns, and the same seed."""
    row = fingerprint(data).first()
    return config_hash({"config": config, "columns": sorted(data.dtypes), "data": list(row), "seed": seed})


def persist(frames: dict[str, DataFrame], path: str, run: str, config: dict, metrics: dict | None = None, replace: bool = False) -> bool:
    """Writes each frame under the run's id and the manifest last; False if the run is there already and not to be replaced.

    A run without a manifest was cut off; it is written anew.
    """
    if not frames:
        raise ValueError("nothing to write")
    spark = next(iter(frames.values())).sparkSession
    known = stored(spark, f"{path}/{MANIFESTS}/run={run}")
    if known is not None and not replace:
        return False
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
    clean = {k: v for k, v in (metrics or {}).items() if v is None or v == v and abs(v) != float("inf")}
    row = (sorted(frames), json.dumps(config, sort_keys=True, default=str), json.dumps({k: clean.get(k) for k in metrics or {}}, sort_keys=True), datetime.now(timezone.utc))
    spark.createDataFrame([row], "tables array<string>, config string, metrics string, written timestamp").write.mode("overwrite").parquet(f"{path}/{MANIFESTS}/run={run}")
    return True


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """run, tables, config, metrics, written of every complete run."""
    return spark.read.parquet(f"{path}/{MANIFESTS}")


def load(spark: SparkSession, path: str, name: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}/run={run}")


def metric(metrics: Column | str, name: str) -> Column:
    """A number of stored JSON metrics; null where it is absent or not a number."""
    return F.get_json_object(metrics, f"$.{name}").try_cast("double")
