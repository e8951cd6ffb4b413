"""Streams that read all there is of a table and end, for runs that want a table back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-streams-')}"
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_to_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What change(stream of the Parquet table at path) appends until the table is read to its end."""
    # a pattern may stand for one file or a folder of files, a plain path for a folder alone
    stream = change(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))
    out = shared_folder(spark)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
