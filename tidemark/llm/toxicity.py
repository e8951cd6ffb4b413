"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows are dealt by crc32(id) modulo 5: rows of remainder 0 are held out, 1 and 2 give the lexicon (words and word
beginnings whose odds differ between labels), 3 the trees, 4 the calibration, so no step learns from rows that an
earlier one has fitted. Fitting reads a sample of at most about max_rows labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import fold, sampled, short_batches, written

#: Labelled rows that fitting uses, about, at most.
MAX_ROWS = 24_000
#: Lexicon entries, at most.
LEXICON_SIZE = 4000
FOLDS, HELD_OUT, LEXICON, TREES, CALIBRATION = 5, 0, (1, 2), 3, 4
#: Letters of the word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5)
WINDOW, NEAR = 40, 5
WORDS_CACHED = 300_000

#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos usted ustedes tus ti vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!|*", "oieastasil ")
MARKS = "!?.,;:*#$%&@~"

FEATURES = (
    "strong_density", "weak_density", "strong_count", "window_density", "near_second_person", "second_person",
    "disguised_hits", "disguised_words", "capital_words", "exclamations", "marks", "words", "mark_runs",
)

STRONG, WEAK, PERSON, CAPITAL, DISGUISED, HIDDEN = 1, 2, 4, 8, 16, 32


def _bare(word: str) -> str:
    return word.lower().strip("!?.,;:*#$%&@~|\"'()[]{}<>-_=+")


def keys_of(word: str) -> list[str]:
    """What the lexicon may hold of a bare word: itself, and its beginnings marked by a tilde."""
    return [word] + [word[:n] + "~" for n in BEGINNINGS if len(word) > n] if len(word) > 2 else []


class Featurizer(dict):
    """Flags of a word by the word; features of a text from the flags of its words."""

    def __init__(self, strong: frozenset, weak: frozenset):
        self.strong, self.weak = strong, weak

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_CACHED:
            self.clear()
        bare = _bare(word)
        flags = 0
        keys = keys_of(bare)
        if any(k in self.strong for k in keys):
            flags |= STRONG
        elif any(k in self.weak for k in keys):
            flags |= WEAK
        if bare in SECOND_PERSON:
            flags |= PERSON
        if len(bare) > 1 and word.isupper():
            flags |= CAPITAL
        if bare and not bare.isalpha() and any(map(str.isalpha, bare)):
            flags |= DISGUISED
            plain = "".join(filter(str.isalpha, bare.translate(DISGUISES)))
            if any(k in self.strong for k in keys_of(plain)):
                flags |= HIDDEN
        self[word] = flags
        return flags

    def features(self, text: str | None) -> list[float]:
        """Dense features; all zero for a null or blank text."""
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        flags = np.fromiter(map(self.__getitem__, words), np.uint8, n)
        hit = (flags & (STRONG | HIDDEN)) > 0
        hits = int(hit.sum())
        window = near = 0.0
        if hits:
            run = np.concatenate([[0], np.cumsum(hit)])
            window = float((run[min(n, WINDOW) :] - run[: n + 1 - min(n, WINDOW)]).max()) / min(n, WINDOW)
            person = np.concatenate([[0], np.cumsum((flags & PERSON) > 0)])
            at = np.flatnonzero(hit)
            near = float((person[np.minimum(n, at + NEAR + 1)] > person[np.maximum(0, at - NEAR)]).mean())
        share = lambda bit: float(((flags & bit) > 0).mean())
        chars = len(text)
        return [
            hits / n, share(WEAK), math.log1p(hits), window, near, share(PERSON), share(HIDDEN), share(DISGUISED), share(CAPITAL),
            text.count("!") / chars, sum(map(text.count, MARKS)) / chars, math.log1p(n), (text.count("!!") + text.count("??") + text.count("**")) / n,
        ]


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> tuple[frozenset, frozenset]:
    """(strong, weak) entries from rows (text, toxic): log odds of the share of toxic and clean texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[str] = []
            toxic: list[int] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for w in set((text or "").split()) for k in keys_of(_bare(w))}
                keys += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(toxic, pa.int32())], ["key", "toxic"])

    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))  # a text that both labels have is toxic
    n = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n[0] or not n[1]:
        return frozenset(), frozenset()
    counted = rows.select("text", "toxic").mapInArrow(run, "key string, toxic int").groupBy("key").agg(F.sum("toxic").alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[0] + 1)) - F.log((F.col("c") + 0.5) / (n[1] + 1))
    least = max(2, round(0.004 * n[0]))
    found = counted.where(F.col("t") >= least).select("key", "t", odds.alias("odds")).where("odds > 1.5")
    top = found.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "key").limit(size).collect()
    return frozenset(r.key for r in top if r.odds > 3), frozenset(r.key for r in top if r.odds <= 3)


def with_features(docs: DataFrame, lexicon: tuple[frozenset, frozenset], text_col: str = "text") -> DataFrame:
    """docs with a column __features; all columns pass through."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Featurizer(*lexicon)
        for batch in batches:
            found = pa.array([own.features(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "__features"])

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema, StructField("__features", ArrayType(DoubleType()))]))


class ToxicityModel:
    """Lexicon, trees and calibration; share is the score where there was nothing to fit."""

    def __init__(self, lexicon: tuple[frozenset, frozenset], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with a column __score between 0 and 1; all columns and rows stay."""
        if self.trees is None:
            return docs.withColumn("__score", F.lit(self.share))
        rows = with_features(docs, self.lexicon, text_col)
        rows = self.trees.transform(rows.withColumn("__vector", array_to_vector("__features")))
        score = vector_to_array("__probability")[1]
        if self.calibration is not None:
            rows = self.calibration.transform(rows)
            score = F.col("__calibrated")
        return rows.select(*docs.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("__score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Learns from labelled documents that are not held out; null labels, ids and texts are left out of fitting."""
    short_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("__id"), FOLDS) != HELD_OUT).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    known = sampled(known, n, max_rows, "__id")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null")
    rows = written(rows.join(F.broadcast(known), "__id").select("text", "toxic", fold(F.col("__id"), FOLDS).alias("fold")))
    by = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    total = sum(by.values())
    share = sum(v for (_, t), v in by.items() if t) / total if total else 0.0
    both = lambda k: by.get((k, 0), 0) and by.get((k, 1), 0)
    lexicon = learn_lexicon(rows.where(F.col("fold").isin(*LEXICON)))
    if not both(TREES):
        return ToxicityModel(lexicon, None, None, share)
    ready = with_features(rows.where(F.col("fold").isin(TREES, CALIBRATION)), lexicon)
    ready = written(ready.select("fold", F.col("toxic").cast("double").alias("toxic"), "__features").coalesce(4))
    ready = ready.select("fold", "toxic", array_to_vector("__features").alias("__vector")).coalesce(2)
    grower = GBTClassifier(featuresCol="__vector", labelCol="toxic", predictionCol="__prediction", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=7)
    grower.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    trees = grower.fit(ready.where(F.col("fold") == TREES))
    if not both(CALIBRATION):
        return ToxicityModel(lexicon, trees, None, share)
    judged = trees.transform(ready.where(F.col("fold") == CALIBRATION)).select("toxic", "__probability")
    calibration = IsotonicRegression(featuresCol="__probability", featureIndex=1, labelCol="toxic", predictionCol="__calibrated").fit(judged)
    return ToxicityModel(lexicon, trees, calibration, share)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Null and blank texts have zero features and get the score that the trees give these. Repeated rows give a row each,
    other columns are ignored, an empty table gives no rows. With no labelled rows of both classes every score is the
    toxic share of the labels (0 without labels).
    """
    model = fit(docs, labels, id_col, text_col)
    scored = model.score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return scored.select("id", (fold(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; all columns stay."""
    return fit(docs, labels, id_col, text_col).score(docs, text_col).where("__score < 0.5").drop("__score")
