"""Exact dedup by skew-safe combining.

Each scan task first combines its own equal texts (Spark's partial aggregation), salted groups merge those winners, and
a last aggregation combines the winners of all salts. The text is a grouping key in every step, so equality is always
equality of full content and the digest only spreads the rows. A group of any size reaches a task as one row for each
task or salt that saw it, and what a large group's rows are to know is broadcast to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hot_bound, join_hot, written

SALTS = 16


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), ascii_lower(F.col(text_col)).alias("text"))
    return rows.withColumn("digest", F.xxhash64("text"))


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: text, digest, keep_id (largest id), group_size (rows)."""
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "text", "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (hex of the normalised text), digest.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The largest id of a group stays.
    Repeated rows (same id, same text) give a row each, all count in group_size, and all are kept if one is; keep_first
    keeps one of them. Null ids: a group of null ids only keeps its null rows. Other columns are ignored, an empty table
    gives no rows. digest is a 64-bit hash of the normalised text.
    """
    rows = _normalised(docs, id_col, text_col)
    won = written(winners(rows, salts).select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    key = "digest"
    if won.groupBy("digest").count().where("count > 1").isEmpty():
        members = written(rows.select("id", "digest"))
    else:  # two texts with one digest: what tells them apart is the longer one
        key = "text_sha256"
        members = written(rows.select("id", "digest", F.sha2("text", 256).alias("text_sha256")))
        won = won.drop("digest")
    found = join_hot(members, won, key, F.col("group_size") > hot_bound(members.count()))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, and with one of repeated rows; all columns stay."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    kept = written(kept.toDF("__id", "__digest", "__copies"))
    rows = docs.withColumn("__text", F.xxhash64(ascii_lower(F.col(text_col))))
    same = rows[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest"))
    left = rows.join(kept, same).drop("__id", "__digest")
    repeated = left.where("__copies > 1").dropDuplicates([id_col, "__text"])
    return left.where("__copies = 1").unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))
