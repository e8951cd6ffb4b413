"""Subword lattice likelihood.

The vocabulary and its order come from an existing sentencepiece file; nothing is added to it. A piece's unigram score
is the logarithm of its share of the training text when the file's own scores pick the segmentation (every piece has an
added count). A word's probability sums the products of piece probabilities over all its segmentations, by the forward
recursion in log space; single-byte pieces make every word possible. A text is its words and an end piece, so its
probability is the product over them.

Counts cover the whole training text. Each distinct word goes through the lattice once; words of a head whose size is
bounded reach the scoring tasks by broadcast, all others by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, short_batches, written

#: Words whose scores are broadcast, at most; all others are joined.
HEAD_WORDS = 120_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 300_000
PIECE_ADDED = 0.1
LN10 = math.log(10.0)
#: sentencepiece's mark of a word's start.
START = "▁"


def words_of(text: str | None) -> list[bytes]:
    """The words of the text with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, train: str, text_col: str = "text") -> DataFrame:
    """(word, c) for each distinct word of the whole table; c counts it in rows where the column `train` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for learn, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if learn:
                    counts.update(words)
                else:
                    counts.update(dict.fromkeys(words, 0))
            if len(counts) > HELD_WORDS:
                yield out()
                counts.clear()
        yield out()

    counted = docs.select(train, F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


@cache
def _pieces(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def piece_counts(words: DataFrame, model: str) -> DataFrame:
    """(piece, n): how often each piece occurs when the file's scores segment the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, counts = _pieces(model), Counter()
        for batch in batches:
            for ids, c in zip(sp.encode(batch.column(0).to_pylist(), num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    counts[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    return words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log probabilities of the pieces, and the forward recursion over them."""

    def __init__(self, model: str, counts: dict[int, int], ends: int):
        sp = _pieces(model)
        size = sp.get_piece_size()
        total = sum(counts.values()) + ends + PIECE_ADDED * (size + 1)
        self.logs: dict[str, float] = {}
        self.bytes: list[float] = [0.0] * 256
        for i in range(size):
            log = math.log((counts.get(i, 0) + PIECE_ADDED) / total)
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = log
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.logs[sp.id_to_piece(i)] = log
        self.end = math.log((ends + PIECE_ADDED) / total)
        self.longest = max(map(len, self.logs))

    def word(self, word: str) -> float:
        """Natural log of the word's probability over all segmentations; characters outside the pieces go by bytes."""
        text, logs, longest = START + word, self.logs, self.longest
        n = len(text)
        forward = [0.0] + [-math.inf] * n
        for i in range(n):
            at = forward[i]
            own = at + sum(map(self.bytes.__getitem__, text[i].encode()))  # always possible
            ahead = forward[i + 1]
            forward[i + 1] = own if ahead == -math.inf else max(own, ahead) + math.log1p(math.exp(-abs(own - ahead)))
            for j in range(i + 1, min(n, i + longest) + 1):
                log = logs.get(text[i:j])
                if log is not None:
                    log += at
                    ahead = forward[j]
                    if ahead == -math.inf:
                        forward[j] = log
                    elif log > ahead:
                        forward[j] = log + math.log1p(math.exp(ahead - log))
                    else:
                        forward[j] = ahead + math.log1p(math.exp(log - ahead))
        return forward[n]


def score_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from rows whose crc32(id) modulo `modulus` is not `held`. Tokens are the words (A-Z lower-cased) and one end;
    a null text is empty and has the end only. A table without training rows scores by the added counts alone. Repeated
    rows give a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (fold(F.col(id_col), modulus) == held).alias("held_out"),
        (fold(F.col(id_col), modulus) != held).alias("train"),
        F.col(text_col).cast("string").alias("text"),
    )
    counted = written(word_counts(rows, "train"))
    totals = counted.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = rows.where("train").count()
    n, v = (totals.n or 0) + ends, totals.v + (ends > 0)
    pieces = dict(map(tuple, piece_counts(counted, model).collect()))  # at most the vocabulary
    lattice = spark.sparkContext.broadcast(Lattice(model, pieces, ends))
    below = float(n + 1 * (v + 1))

    def base(c: int) -> float:
        return math.log10((c + 1) / below)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_log = lattice.value.word
        for batch in batches:
            logs = pa.array([word_log(w) / LN10 for w in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, logs], ["word", "c", "lattice"])

    table = written(counted.mapInArrow(through, "word string, c long, lattice double"))
    sizes = sorted(map(tuple, table.where("c > 1").groupBy(F.floor(F.log2("c") * 4).alias("k")).agg(F.count(F.lit(1)), F.min("c")).collect()), reverse=True)
    least, size = None, 0  # of the head: a few hundred classes of counts tell where it may begin
    for _, many, c in sizes:
        size += many
        if size > head_words:
            break
        least = c
    head_rows = table.where(F.col("c") >= least).collect() if least else []
    head = spark.sparkContext.broadcast({r.word.encode(): (base(r.c), r.lattice) for r in head_rows})
    end = (base(ends), lattice.value.end / LN10)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what its head words add, and a row for each of its other words."""
        known, at = head.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, held_out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at += 1
                words = words_of(text)
                counts = Counter(words)
                b, s, hits, rest = end[0], end[1], int(ends > 0), []
                for word, many in counts.items():
                    pair = known.get(word)
                    if pair is None:
                        rest.append((word.decode(), many))
                    else:
                        b += many * pair[0]
                        s += many * pair[1]
                        hits += many
                for row in [(at, f" {at % 997}", 0, i, held_out, len(words) + 1, (b, s), hits)] + [(at, w, m, None, None, 0, (0.0, 0.0), 0) for w, m in rest]:
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
            pairs = cols[6]
            arrays = [
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64()), pa.array([p[0] for p in pairs], pa.float64()),
                pa.array([p[1] for p in pairs], pa.float64()), pa.array(cols[7], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["at", "word", "many", "id", "held_out", "tokens", "b", "s", "hits"])

    dealt = rows.select("id", "held_out", "text").mapInArrow(
        split, "at long, word string, many int, id long, held_out boolean, tokens long, b double, s double, hits long"
    )
    rest = table.where(F.col("c") < least) if least else table
    joined = dealt.join(rest.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    many, c = F.col("many"), F.coalesce("c", F.lit(0))
    tail = joined.select(
        "at", "id", "held_out", "tokens",
        (F.col("hits") + F.when(c > 0, many).otherwise(0)).alias("hits"),
        (F.col("b") + many * F.log10((c + 1) / F.lit(below))).alias("b"),
        (F.col("s") + many * F.coalesce("lattice", F.lit(0.0))).alias("s"),
    )
    return (
        tail.groupBy("at")
        .agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum("hits").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
        .select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )
