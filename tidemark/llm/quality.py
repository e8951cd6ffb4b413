"""Quality by weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of all vote
patterns (a table bounded by the number of patterns) estimates each labeller's accuracy and the share of good documents;
the posterior of a pattern is the label of its documents. The posteriors of a bounded sample train a linear scorer over
hashed words and word shapes, which scores every whole text. No gold label is used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import sampled, short_batches, written

#: Documents that the scorer learns from, about, at most.
MAX_ROWS = 6000
HASH_BITS = 15
#: Shares of words are small numbers; the scorer sees them times this.
SCALE = 20.0
WORDS_CACHED = 300_000
GOOD, NONE, BAD = 2, 1, 0

#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset("the of and to in a is that for it as with on be at by this are was or from der die und in den von zu das mit sich des auf für ist im dem nicht ein eine le la les et des en un une du dans que est pour qui sur pas au el los las y del que en un una por con para se".split())
_NOISY = re.compile(r"[^\w\s]{2,}(?=\s|$)")


class _Case(dict):
    """Capitals of a word, times 2**32, and its letters."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_CACHED:
            self.clear()
        both = self[word] = (sum(map(str.isupper, word)) << 32) + sum(map(str.isalpha, word))
        return both


_CASE = _Case()

LABELLERS = ("symbols", "capitals", "tables", "one_word", "stutter", "function_words", "length", "lines", "sentences")


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(text: str | None) -> list[int]:
    """One vote per labeller; a null or blank text gets a bad vote for its length and none else."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [NONE] * 6 + [BAD] + [NONE] * 2
    noisy = len(_NOISY.findall(text)) / n
    capitals, letters = divmod(sum(map(_CASE.__getitem__, words)), 1 << 32)
    upper = capitals / max(1, letters)
    bars = text.count("|") / n
    lower = text.lower().split()
    counts = Counter(lower)
    top = counts.most_common(1)[0][1] / n
    stutter = sum(map(str.__eq__, lower, lower[1:])) / n
    function = sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    ends = (text.count(".") + text.count("?") + text.count("!")) / n
    return [
        _vote(noisy > 0.2, noisy < 0.02),
        _vote(upper > 0.5, upper < 0.15),
        _vote(bars > 0.15, False),
        _vote(n >= 20 and top > 0.25, n >= 20 and top < 0.12),
        _vote(n >= 10 and stutter > 0.15, n >= 10 and stutter < 0.02),
        _vote(n >= 20 and function < 0.04, n >= 20 and function > 0.15),
        _vote(n < 3, n >= 40),
        _vote(len(lines) >= 3 and repeated > 0.4, len(lines) >= 3 and repeated < 0.1),
        _vote(n >= 30 and ends < 0.005, 0.02 < ends < 0.3),
    ]


def _pattern(text: str | None) -> int:
    code = 0
    for v in votes(text):
        code = code * 3 + v
    return code


def fit_labellers(patterns: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, float, dict[int, float]]:
    """(probability of each vote by class and labeller, share of good documents, posterior by pattern)."""
    if not patterns:
        return np.full((2, len(LABELLERS), 3), 1 / 3), 0.5, {}
    codes = np.array(sorted(patterns))
    weight = np.array([patterns[c] for c in codes], dtype=float)
    vote = np.stack([codes // 3 ** (len(LABELLERS) - 1 - j) % 3 for j in range(len(LABELLERS))], axis=1)
    good, bad = (vote == GOOD).sum(axis=1), (vote == BAD).sum(axis=1)
    posterior = (good + 1) / (good + 3 * bad + 2)  # a bad vote is rarer, and so says more
    chosen = np.stack([vote == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        by = np.stack([weight * (1 - posterior), weight * posterior])
        table = np.einsum("cp,pjv->cjv", by, chosen) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        share = by.sum(axis=1) / weight.sum()
        logs = np.einsum("cjv,pjv->cp", np.log(table), chosen) + np.log(np.clip(share, 1e-9, 1))[:, None]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return table, float(share[1]), {int(c): float(p) for c, p in zip(codes, posterior, strict=True)}


class _Kinds(dict):
    """Letters by case and digits, each as one sign; all else stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_KINDS = _Kinds()
_RUNS = re.compile(r"([aA9])\1+")


class _Slots(dict):
    """Hashed slots of a word: the word itself and its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > WORDS_CACHED:
            self.clear()
        shape = _RUNS.sub(r"\1", word.translate(_KINDS))
        pair = self[word] = tuple(zlib.crc32(x.encode()) & ((1 << HASH_BITS) - 1) for x in (word.lower(), "shape " + shape))
        return pair


def _hashed(slots: _Slots, text: str | None) -> dict[int, float]:
    words = (text or "").split()
    counts: Counter = Counter()
    for word, many in Counter(words).items():
        for slot in slots[word]:
            counts[slot] += many
    return {k: SCALE * v / len(words) for k, v in counts.items()}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: id, weak_label (posterior), score (0 to 1), predicted (1: good).

    A null text counts as empty and is scored by the intercept alone. Repeated rows give a row each; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = StructType([StructField("id", rows.schema["id"].dataType), StructField("pattern", IntegerType())])

    def vote_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([_pattern(t.as_py()) for t in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["id", "pattern"])

    patterns = {r["pattern"]: r["count"] for r in rows.mapInArrow(vote_on, kinds).groupBy("pattern").count().collect()}
    posterior = fit_labellers(patterns)[2]
    total = sum(patterns.values())
    # by id and text, so that rows of one id do not come or go together
    part = sampled(rows, total, max_rows, "id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [sorted(_hashed(slots, t).items()) for t in texts]
            labels = pa.array([posterior[_pattern(t)] for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [labels, pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[v for _, v in f] for f in found], pa.list_(pa.float64()))],
                ["posterior", "slots", "shares"],
            )

    sparse = F.udf(lambda k, v: Vectors.sparse(1 << HASH_BITS, k, v), VectorUDT())  # on the bounded sample alone
    ready = written(part.mapInArrow(hashed, "posterior double, slots array<int>, shares array<double>").coalesce(8))
    ready = ready.select(sparse("slots", "shares").alias("features"), F.explode(F.array(*(F.struct(F.lit(y).alias("label"), w.alias("weight")) for y, w in ((1.0, F.col("posterior")), (0.0, 1 - F.col("posterior")))))).alias("x"))
    ready = ready.select("features", "x.*").where("weight > 0.001")
    good = sum(n * posterior[c] for c, n in patterns.items())
    intercept, weights = float(np.log((good + 1) / (total - good + 1))), np.zeros(1 << HASH_BITS)
    if not ready.isEmpty():
        fitted = LogisticRegression(maxIter=60, regParam=1e-5, weightCol="weight", standardization=False).fit(ready)
        intercept, weights = float(fitted.intercept), fitted.coefficients.toArray()
    shared = spark.sparkContext.broadcast((intercept, weights, posterior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intercept, weights, posterior = shared.value

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > WORDS_CACHED:
                    self.clear()
                own = self[word] = sum(map(weights.__getitem__, slots.__missing__(word)))
                return own

        slots = _Slots()
        weights = weights.tolist()
        of = Weights().__getitem__
        for batch in batches:
            scores, labels = [], []
            for text, code in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").split()
                margin = intercept + (SCALE * sum(map(of, words)) / len(words) if words else 0.0)
                scores.append(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
                labels.append(posterior.get(code, 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.float64()), pa.array(scores, pa.float64())], ["id", "weak_label", "score"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from score(pa.RecordBatch.from_arrays([*b.columns, pa.array([_pattern(t.as_py()) for t in b.column(1)], pa.int32())], ["id", "text", "pattern"]) for b in batches)

    scored = rows.mapInArrow(marked, "id long, weak_label double, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
