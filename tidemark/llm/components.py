"""Connected components of a link table, by alternating large-star and small-star steps of joins and aggregations.

A node with very many links is a hot join key. Such nodes are few (their number is bounded by the links), so what is to
be handed to their neighbours is broadcast and their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_bound, join_hot, written


def _with_least(edges: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """rows (a, b) with m, the least b that edges have for a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(rows, least, "a", F.col("n") > most)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node hands its larger neighbours to the least of itself and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = _with_least(both, both.where("b > a"), most)
    return rows.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them; edges have a > b."""
    moved = _with_least(edges, edges, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("b"))
    return moved.union(least).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of distinct rows; equal marks mean that nothing changed."""
    # a sum of hashes overflows a long on a few hundred thousand rows
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links; component is the smallest node that it reaches.

    Links may repeat, point either way or join a node to itself; rows with a null end are ignored and nodes without
    links do not appear. Every round is written to the shared folder, so lineage stays short.
    """
    x, y = F.col(a), F.col(b)
    edges = written(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        most = hot_bound(2 * mark[0])
        spread = written(_large_star(edges, most))
        moved = written(_small_star(spread, most))
        discard(edges, spread)
        edges = moved
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
