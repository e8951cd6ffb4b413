"""SimHash near-dedup by anchor-point covering.

The fingerprint is cut into blocks so that two fingerprints within the threshold agree up to one bit in some block. The
anchors of a block are the words of a perfect Hamming code: every block value lies within one bit (the covering radius)
of exactly one anchor, its home. A fingerprint is copied to each anchor within radius + 1 bits, so a linked pair always
meets at the home of either. Only distinct fingerprints take part, anchors with very many rows are dealt out over cells,
and an anchor reports a spanning set of its verified links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_bound, join_hot, short_batches, written
from .components import connected_components

SEED = 42
SHINGLE = 3
BITS = 64
#: Rows of one anchor that one cell compares.
CELL_ROWS = 4096
#: Largest table of crowded anchors that is broadcast.
BROADCAST_ANCHORS = 50_000

#: Each value of a byte with its bits spread over eight 8-bit counters.
_SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `size` words of the text with A-Z lower-cased; of the whole sequence when it is shorter."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(size)), strict=False)]


def majority_bits(hashes: list[int]) -> int:
    """The 64 bits that are set in over half the hashes, as a signed long."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 255 * 64):  # 255 rows fit an 8-bit counter
        lanes = _SPREAD[h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row; fp is 0 for a text without words (null texts too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, fp long"
    )


def _block(max_distance: int) -> tuple[int, int, int]:
    """Blocks, bits from one block to the next, and bits of a block that its code uses (2**m - 1)."""
    blocks = max(1, (max_distance + 2) // 2)
    width = BITS // blocks
    return blocks, width, (1 << ((width + 1).bit_length() - 1)) - 1


def anchors(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, is home) of every copy of the fingerprints: all anchors within covering radius + 1 in each block."""
    blocks, width, n = _block(max_distance)
    fps = fps.astype(np.uint64)
    keys, copies, homes = [], [], []
    for k in range(blocks):
        x = (fps >> np.uint64(k * width)) & np.uint64((1 << n) - 1)
        syndrome = np.zeros(len(x), dtype=np.uint64)
        for i in range(1, n + 1):
            syndrome ^= np.uint64(i) * ((x >> np.uint64(i - 1)) & np.uint64(1))
        off = syndrome > 0
        home = np.where(off, x ^ (np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1))), x)
        tag = np.uint64(k) << np.uint64(62)
        keys.append(home | tag if n <= 62 else home)
        copies.append(fps)
        homes.append(np.ones(len(x), dtype=bool))
        for i in range(1, n + 1):  # two flips lead to an anchor exactly when their places differ by the syndrome
            j = np.uint64(i) ^ syndrome
            at = off & (j > i)
            keys.append((x ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (np.maximum(j, np.uint64(1)) - np.uint64(1))))[at] | tag)
            copies.append(fps[at])
            homes.append(np.zeros(int(at.sum()), dtype=bool))
    return tuple(np.concatenate(v) for v in (keys, copies, homes))


def _spanning_links(fps: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins fingerprints within max_distance bits."""
    links, rest = [], np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_distance
            if near.any():
                links += [(int(x), int(y)) for y in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return links


def near_links(fps: DataFrame, max_distance: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): verified links between distinct fingerprints that connect whatever all links would connect.

    fps has one column fp, a signed 64-bit number; repeats are harmless.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 20_000):
                key, fp, home = anchors(values[at : at + 20_000], max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)], ["key", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last group, which the next batch may continue

        def links_of(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
            return _spanning_links(fp.view(np.uint64), max_distance) if home.any() else []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            links: list[tuple[int, int]] = []
            first = (int(key[0]), int(cell[0]))
            if held and first != last:
                links += links_of(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held = []
            if held and len(starts) > 1:
                held.append((fp[: ends[0]], home[: ends[0]]))
                links += links_of(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held, starts, ends = [], starts[1:], ends[1:]
            inner = np.flatnonzero(ends[:-1] - starts[:-1] > 1)
            for k in inner:
                links += links_of(fp[starts[k] : ends[k]], home[starts[k] : ends[k]])
            held.append((fp[starts[-1] : ends[-1]], home[starts[-1] : ends[-1]]))
            last = (int(key[-1]), int(cell[-1]))
            if links:
                yield out(links)
        if held:
            yield out(links_of(*(np.concatenate(v) for v in zip(*held, strict=True))))

    dealt = fps.select("fp").mapInArrow(deal, "key long, fp long, home boolean")
    crowded = written(dealt.groupBy("key").count().where(F.col("count") > cell_rows).select("key", F.ceil(F.col("count") / cell_rows).cast("int").alias("cells")))
    n = crowded.count()
    if n:  # copies of a crowded anchor go to one cell each, its homes to all
        joined = dealt.join(F.broadcast(crowded) if n <= BROADCAST_ANCHORS else crowded, "key", "left")
        own = F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("cells").cast("long")).cast("int"))
        every = F.when(F.col("home") & F.col("cells").isNotNull(), F.sequence(F.lit(0), F.col("cells") - 1)).otherwise(F.array(own))
        dealt = joined.select("key", F.explode(every).alias("cell"), "fp", "home")
    else:
        dealt = dealt.select("key", F.lit(0).alias("cell"), "fp", "home")
    met = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return met.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_distance: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links of fingerprints.

    Texts without words (empty, blank or null) have fingerprint 0 and link like any other. Repeated rows give a row
    each. Null ids: they never name a component while the group has another id. An empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    marked = written(fingerprints(docs, id_col, text_col, shingle))
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    labels = connected_components(near_links(distinct, max_distance))
    grouped = written(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component")))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    by_fp = join_hot(grouped, named, "component", F.col("fps") > hot_bound(distinct.count())).select("fp", "copies", "component_id")
    found = join_hot(marked, by_fp, "fp", F.col("copies") > hot_bound(marked.count()))
    return found.select("id", "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 3) -> DataFrame:
    """docs with the smallest id of each near-duplicate group; all columns stay. A group of null ids keeps those."""
    groups = near_groups(docs, id_col, text_col, max_distance=max_distance)
    kept = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]), "left_semi")
