"""Source divergence audit: how far each source's word use is from the other sources of its language.

Scan tasks count terms in dictionaries, one shuffle by term brings their counts together, and rare terms end there. The
kept counts are dealt into tiles: a block of a language's terms against two blocks of its sources. A tile is a dense int64
matrix of groups by terms; broadcasting takes all pairs of its rows at once, and what leaves it is one partial sum for each
pair and the best terms of each group. Sums and short lists of all tiles are then merged. A tile's size does not depend on
the number of documents, terms or sources: more terms make more blocks, more sources more pairs of blocks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hot_bound, join_hot, written

SCALE = 1_000_000_000
#: Terms and groups of a block, about (they are dealt by hash).
BLOCK_TERMS = 1024
BLOCK_GROUPS = 128
#: Counters of a scan task before it hands them on, and cells of one broadcast step.
HELD_TERMS = 400_000
STEP_CELLS = 1 << 21
TOP_TERMS = 10
LEAST_DOCS = 10
#: Byte classes: ASCII letters become lower case, bytes of longer characters stay, all else parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included: runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_LETTERS).split()


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text): partial counts, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                if n:
                    size = len(n)
                    same = [pa.array([x], pa.string()).take(pa.array(np.zeros(size, np.int32))) for x in (lang, source)]
                    counts = [pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, n)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(list(n), pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources, texts = batch.columns
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.binary()), strict=True):
                words = terms_of(text.as_py())
                n, docs = held[lang, source]
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from out()
        yield from out()

    return rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total) of the terms in at least least_docs documents of their language; total: n of the language.

    One shuffle by (lang, term), which the sums by source and the window over sources both use.
    """
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = counts.withColumns({"total": F.sum("n").over(term), "docs": F.sum("docs").over(term)})
    return whole.where(F.col("docs") >= least_docs).drop("docs")


def shares(counts: np.ndarray, sums: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (sum + 2 * kept)), exact: long division by three digits at a time."""
    under = np.asarray(sums, np.int64) + 2 * kept
    if np.any(under > np.iinfo(np.int64).max // 1000):
        raise OverflowError("a group has more than 9.2e15 terms")
    whole, left = np.divmod(counts + 2, under) if counts.size else (counts, counts)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, under) if counts.size else (counts, counts)
        whole = whole * 1000 + digit
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)), elementwise with broadcasting."""
    apart = p - q
    return apart * apart // (p + q)


def pair_sums(p: np.ndarray) -> np.ndarray:
    """Matrix of sums of gaps over the columns, for all pairs of rows of p."""
    groups, terms = p.shape
    sums = np.zeros((groups, groups), np.int64)
    wide = min(max(1, terms), max(1, STEP_CELLS // max(1, groups)))
    high = max(1, STEP_CELLS // max(1, groups * wide))
    for at in range(0, terms, wide):
        part = p[:, at : at + wide]
        for i in range(0, groups, high):
            sums[i : i + high] += gaps(part[i : i + high, None, :], part[None, :, :]).sum(axis=2)
    return sums


def _tile(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """Partial pair sums (each pair once) and best terms of one tile; rows without a term are its groups."""
    info = rows[rows.term.isna()].sort_values("source")
    lang, first, second, kept, lang_sum = (info[c].iloc[0] for c in ("lang", "a", "b", "kept", "lang_sum"))
    cells = rows[rows.term.notna()]
    column, terms = pd.factorize(cells.term)
    row = np.searchsorted(info.source.to_numpy(object), cells.source.to_numpy(object))
    counts, totals = np.zeros((len(info), len(terms)), np.int64), np.zeros(len(terms), np.int64)
    counts[row, column] = cells.n
    totals[column] = cells.total
    p = shares(counts, info["sum"].to_numpy(np.int64)[:, None], kept)
    sums, block, sources = pair_sums(p), info.block.to_numpy(), info.source.to_numpy(object)
    i, j = np.triu_indices(len(info), 1)
    apart = (block[i] != block[j]) | (first == second)  # pairs within a block belong to the tile of that block alone
    i, j = i[apart], j[apart]
    out = [pd.DataFrame({"lang": lang, "source": sources[i], "part": "pair", "item": sources[j], "value": sums[i, j]})]
    if first == second and len(terms):
        q = shares(totals, lang_sum, kept)
        order = np.argsort(terms.astype(object), kind="stable")  # ties: the smaller term first
        for s in range(len(info)):
            at = order[(counts[s, order] > 0) & (p[s, order] > q[order])]
            f = gaps(p[s, at], q[at])
            best = np.argsort(-f, kind="stable")[:top]
            out.append(pd.DataFrame({"lang": lang, "source": sources[s], "part": "term", "item": terms[at[best]], "value": f[best]}))
    return pd.concat(out, ignore_index=True)


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    block_terms: int = BLOCK_TERMS,
    block_groups: int = BLOCK_GROUPS,
) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source), its distance to each other source of the
    language (part pair, all ranks) and its most typical terms (part term, up to `top`).

    A language keeps the terms that occur in at least least_docs of its rows. A group's share of a kept term is
    1 + floor(10**9 (n + 2) / (N + 2 V)), for n its count, N the group's sum and V the language's number of kept terms; a
    pair's value sums floor((p - q)**2 / (p + q)) over the kept terms, a term's value is that of the group's share against
    the language's where the group has the term and a larger share. Ranks go by value descending, then item in UTF-8.

    Null or empty texts have no terms, yet their group is there; null lang or source is the empty string. Repeated rows
    count as often as they occur, texts of any length are read whole, ties go by item. A language with one source has no
    pairs, one without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = written(kept_counts(rows, least_docs))
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("rows"))
    groups = written(rows.select("lang", "source").distinct().join(found, ["lang", "source"], "left").fillna(0, ["sum", "rows"]))
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = (
        groups.groupBy("lang")
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"))
        .join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_sum")), "lang", "left")
        .fillna(0, ["kept", "lang_sum"])
        .withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)))
        .withColumn("group_blocks", F.ceil(F.col("groups") / block_groups))
    )
    langs = written(langs)
    most = hot_bound(kept.count())
    cells = join_hot(kept, langs, "lang", F.col("rows") > most)
    cells = cells.withColumn("term_block", F.expr("pmod(xxhash64(term), term_blocks)")).withColumns({"sum": F.lit(None).cast("long")})
    heads = join_hot(groups.drop("rows"), langs, "lang", F.col("groups") > most)
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(None).cast("long"), "total": F.lit(None).cast("long")})
    heads = heads.withColumn("term_block", F.explode(F.expr("sequence(0L, term_blocks - 1)")))
    columns = ["lang", "source", "term", "n", "total", "sum", "kept", "lang_sum", "term_block", "group_blocks"]
    dealt = cells.select(columns).unionByName(heads.select(columns)).withColumn("block", F.expr("pmod(xxhash64(source), group_blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, group_blocks - 1)")))
    dealt = dealt.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "group_blocks")
    schema = "lang string, source string, part string, item string, value long"
    parts = written(dealt.groupBy("lang", "term_block", "a", "b").applyInPandas(lambda tile: _tile(tile, top), schema))
    discard(kept, groups, langs)
    pair = parts.where("part = 'pair'").groupBy("lang", "source", "item", "part").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    both = pair.select("lang", "part", F.explode(ends).alias("x"), "value").select("lang", "x.source", "part", "x.item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", ranked).where(F.col("rank") <= top)
    return both.withColumn("rank", ranked).unionByName(best)
