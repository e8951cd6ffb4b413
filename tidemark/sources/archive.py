"""Raw archive: what a source delivered, byte for byte, under addresses that follow from the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import stored
from ..operators.runs import slug

#: Endings by content type.
ENDINGS = {"text/csv": "csv", "application/json": "json", "text/plain": "txt"}
PAYLOAD = ["provider", "dataset", "entity", "fetched_at", "content_type", "content"]


class ArchiveError(ValueError):
    """Archived bytes are not those that their address names."""


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def address(provider: Column, dataset: Column, entity: Column, fetched_at: Column, content_type: Column, digest: Column) -> Column:
    """provider/dataset/entity/day/first 16 digits of the digest, with the content type's ending."""
    ending = F.lit("bin")
    for kind, end in ENDINGS.items():
        ending = F.when(content_type == kind, end).otherwise(ending)
    folder = F.concat_ws("/", slug(provider), slug(dataset), slug(entity), F.date_format(fetched_at, "yyyy-MM-dd"))
    return F.concat(folder, F.lit("/"), F.substring(digest, 1, 16), F.lit("."), ending)


def read_files(spark: SparkSession, path: str, provider: str, dataset: str, content_type: str = "text/csv") -> DataFrame:
    """Payloads (provider, dataset, entity, fetched_at, content_type, content) of landing files, unparsed; entity is the file's name without its ending, in capitals."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select(F.lit(provider).alias("provider"), F.lit(dataset).alias("dataset"), F.upper(name).alias("entity"), F.col("modificationTime").alias("fetched_at"), F.lit(content_type).alias("content_type"), "content")


def write(payloads: DataFrame, path: str) -> int:
    """Adds payloads to the archive at path, a table by provider and dataset, and returns how many were new.

    A payload whose address and size are there already is left alone, so writing again changes nothing. Payloads that
    repeat within one call are written once. Rows without content are refused.
    """
    spark = payloads.sparkSession
    digest = sha256(F.col("content"))
    content = F.coalesce("content", F.raise_error("a payload has no content").cast("binary"))
    new = payloads.select(*(c for c in PAYLOAD if c != "content"), content.alias("content")).withColumn("sha256", digest)
    new = new.withColumn("address", address(*(F.col(c) for c in PAYLOAD[:5]), F.col("sha256"))).withColumn("size", F.octet_length("content").cast("long"))
    new = new.dropDuplicates(["address"])
    known = stored(spark, path)
    before = 0 if known is None else known.count()
    if known is not None:
        new = new.join(known.select("address", "size"), ["address", "size"], "left_anti")
    new.write.mode("append").partitionBy("provider", "dataset").parquet(path)
    return spark.read.parquet(path).count() - before


def read(spark: SparkSession, path: str, provider: str | None = None, dataset: str | None = None) -> DataFrame:
    """Payloads of the archive with address, sha256 and size; reading content whose digest is another raises an error.

    provider and dataset are partitions: others are not read.
    """
    rows = spark.read.parquet(path)
    for column, value in (("provider", provider), ("dataset", dataset)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    intact = F.when(sha256(F.col("content")) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("altered bytes at "), F.col("address"))).cast("binary"))
    return rows.withColumn("content", intact)
