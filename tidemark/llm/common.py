"""Shared pieces of the text operators: written tables, batch sizes, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters that normalisation lower-cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Keys of a table that can be hot, at most, and rows below which no key is.
HOT_KEYS = 10_000
HOT_LEAST = 64
#: Rows of one Arrow batch: documents vary from a word to megabytes, so batches stay short.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-tables-")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/tables/" not in path:
                raise ValueError(f"{path} is no intermediate table")
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile gives up its shuffle files as it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def hot_bound(rows: int) -> int:
    """Rows from which a key counts as hot: at most HOT_KEYS keys of a table of that many rows can have more."""
    return max(HOT_LEAST, rows // HOT_KEYS)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key, where `hot` picks the rows of right whose keys are hot in left.

    The caller bounds the hot rows by hot_bound, so they are broadcast, and left's rows of hot keys stay where they are;
    only keys with few rows each are shuffled.
    """
    few = F.broadcast(right.where(hot))
    rest = left.join(few.select(key), key, "left_anti").join(right.where(~hot), key, how)
    return left.join(few, key).unionByName(rest)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to BATCH_ROWS rows, so that a batch of long texts fits a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


def ascii_lower(text: Column) -> Column:
    """Text (null: empty) with A-Z lower-cased and nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sampled(rows: DataFrame, total: int, most: int, *by: str) -> DataFrame:
    """About `most` of the `total` rows, picked by a hash of the columns `by`; all rows where there are no more.

    The share is a fraction of 2**53, so it does not round to nothing on very large tables, and never under 1 in 2**53.
    """
    if total <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(*by), 11) < max(1, (most << 53) // total))
