"""Kendall's tau-b of all pairs of columns by counting inversions in sorted chunks: n log n, no join of rows with rows.

Each column is cut into chunks by boundary values, and every boundary value is a chunk of its own, so a value that many
rows share never sits in a chunk that has to be sorted. Two rows that differ in both chunks are counted from a small table
of chunk pairs. Rows that share a chunk of the first column, or only one of the second, meet in that chunk's task, which
counts inversions by merging bit by bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, about, and chunks of a column, at most (a pair's table of chunk pairs has at most 4 million cells).
CHUNK_ROWS = 1_000_000
MOST_CHUNKS = 1000


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j]; equal values are none."""
    ranks = np.unique(y, return_inverse=True)[1].astype(np.int64)
    found, n = 0, len(ranks)
    for bit in reversed(range(int(ranks.max()).bit_length() if n else 0)):
        # rows stay grouped by their higher bits; in a group every one before a zero is an inversion
        high, one = ranks >> (bit + 1), (ranks >> bit) & 1
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        ones = np.cumsum(one)
        before = np.repeat((ones - one)[first], np.diff(np.r_[first, n]))
        found += int((ones - before)[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return found


def _ties(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns."""
    if not len(columns[0]):
        return 0
    order = np.lexsort(columns)
    change = np.zeros(len(order), bool)
    change[0] = True
    for c in columns:
        c = c[order]
        change[1:] |= c[1:] != c[:-1]
    n = np.diff(np.r_[np.flatnonzero(change), len(order)])
    return int((n * (n - 1) // 2).sum())


def _parts(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """(i, j, kind, n) of one chunk of one column: inversions and ties between its rows, with each other column."""
    c = int(rows.c.iloc[0])
    out, own = [], rows[columns[c]].to_numpy(float)
    for other in range(len(columns)):
        if other == c:
            continue
        there = ~np.isnan(rows[columns[other]].to_numpy(float))
        x, y, chunk = own[there], rows[columns[other]].to_numpy(float)[there], rows[f"k{other}"].to_numpy()[there]
        if not len(x):
            continue
        if c < other:  # rows of one chunk of the first column
            out += [(c, other, "inverted", inversions(y[np.lexsort((y, x))])), (c, other, "ties_i", _ties(x)), (c, other, "ties_both", _ties(x, y))]
        else:  # rows of one chunk of the second column, in different chunks of the first
            single = chunk % 2 == 1
            out += [(other, c, "inverted", inversions(x[np.lexsort((x, chunk))])), (other, c, "ties_j", _ties(x)), (other, c, "ties_both", _ties(x[single], chunk[single]))]
    return pd.DataFrame([(*x, str(n)) for *x, n in out], columns=["i", "j", "kind", "n"])


def kendall(rows: DataFrame, columns: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """a, b, n, tau for each ordered pair of columns, itself included: tau-b over the rows that have both (pairwise complete).

    NaN counts as null. tau is null where one of the columns has a single value or fewer than two rows have both.
    """
    spark, p = rows.sparkSession, len(columns)
    values = rows.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(columns)))
    names = [f"v{i}" for i in range(p)]
    counts = values.agg(*(F.count(v).alias(v) for v in names)).first()
    edges = []
    for v in names:
        k = min(MOST_CHUNKS, -(-counts[v] // chunk_rows))
        cuts = values.agg(F.percentile_approx(v, [q / k for q in range(1, k)], 20 * MOST_CHUNKS)).first()[0] if k > 1 else None
        edges.append(sorted(set(cuts or [])))
    # an odd chunk is one boundary value, an even one lies between two of them
    place = lambda v, e: F.when(F.col(v).isNotNull(), F.aggregate(F.array(*map(F.lit, e)), F.lit(0), lambda s, x: s + (F.col(v) > x).cast("int") + (F.col(v) >= x).cast("int")) if e else F.lit(0))
    placed = values.select(*names, *(place(v, e).alias(f"k{i}") for i, (v, e) in enumerate(zip(names, edges))))
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    found: dict[tuple[int, int, str], int] = {}
    if pairs:
        both = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"k{i}").alias("a"), F.col(f"k{j}").alias("b")) for i, j in pairs))).alias("x")
        cells = placed.select(both).select("x.*").where("a IS NOT NULL AND b IS NOT NULL").groupBy("i", "j", "a", "b").count()
        dealt = placed.withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"k{i}").alias("chunk")) for i in range(p)))))
        dealt = dealt.select("*", "x.c", "x.chunk").drop("x").where("chunk % 2 = 0")
        schema = "i int, j int, kind string, n string"  # as text: counts of pairs pass 64 bits
        parts = dealt.groupBy("c", "chunk").applyInPandas(lambda g: _parts(g, names), schema).unionByName(cells.groupBy("i", "j").applyInPandas(_crossed, schema))
        found = {(r.i, r.j, r.kind): int(r.n) for r in parts.groupBy("i", "j", "kind").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
    pairs_found = [(i, j, *_tau({k: found.get((i, j, k), 0) for k in ("rows", "inverted", "ties_i", "ties_j", "ties_both")})) for i, j in pairs]
    table = [(columns[i], columns[j], n, tau) for i, j, n, tau in pairs_found]
    table += [(b, a, n, tau) for a, b, n, tau in table]
    for i, c in enumerate(columns):
        n = counts[names[i]]
        varied = n and values.agg(F.min(names[i]) < F.max(names[i])).first()[0]
        table.append((c, c, n, 1.0 if varied else None))
    return spark.createDataFrame(table, "a string, b string, n long, tau double")


def _pairs_of(n: int) -> int:
    return int(n) * (int(n) - 1) // 2


def _crossed(cells: pd.DataFrame) -> pd.DataFrame:
    """(i, j, kind, n) of one pair from its chunk pairs: its rows, inversions of rows that differ in both chunks, ties at boundary values."""
    matrix = np.zeros((int(cells.a.max()) + 1, int(cells.b.max()) + 1), np.int64)
    matrix[cells.a, cells.b] = cells["count"]
    above = np.cumsum(matrix[::-1], axis=0)[::-1]  # rows of this chunk of i and later ones
    below = np.cumsum(above, axis=1)
    a, b = np.nonzero(matrix[:-1, 1:])
    inverted = sum(int(x) * int(y) for x, y in zip(matrix[a, b + 1], below[a + 1, b]))
    counts = {
        "rows": int(matrix.sum()), "inverted": inverted, "ties_i": sum(map(_pairs_of, matrix.sum(axis=1)[1::2])),
        "ties_j": sum(map(_pairs_of, matrix.sum(axis=0)[1::2])), "ties_both": sum(map(_pairs_of, matrix[1::2, 1::2].ravel())),
    }
    return pd.DataFrame([(int(cells.i.iloc[0]), int(cells.j.iloc[0]), k, str(n)) for k, n in counts.items()], columns=["i", "j", "kind", "n"])


def _tau(counts: dict[str, int]) -> tuple[int, float | None]:
    """Rows and tau-b of one pair from its sums."""
    n, whole = counts["rows"], _pairs_of(counts["rows"])
    agree = whole - counts["ties_i"] - counts["ties_j"] + counts["ties_both"] - 2 * counts["inverted"]
    scale = (whole - counts["ties_i"]) * (whole - counts["ties_j"])
    return n, agree / scale**0.5 if scale else None
